"""Running a case: named steps over a state, with a checkpoint after each, interruption for approval, and resumption.

What a step does (a model, a tool, a person) is given from outside as a function; here is only the order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping

from larkfield.sources.checkpoints import Checkpoints

Step = Callable[[dict], dict]
END = "end"


def signature(steps: Mapping[str, Step], settings: Mapping[str, object]) -> str:
    """What a checkpoint belongs to: the names of the steps and the settings of the run."""
    return hashlib.sha256(json.dumps([sorted(steps), dict(settings)], sort_keys=True, default=str).encode()).hexdigest()[:16]


def initial_state(site: str, as_of: str, site_context: str = "", resource_context: str = "", note: str = "") -> dict:
    """An empty case: four parts without reports, and counters at zero."""
    return {
        "site_of_interest": site, "as_of": as_of, "site_context": site_context, "resource_context": resource_context, "note": note,
        "perception_state": {"perception_rounds": 0}, "diagnosis_state": {"diagnosis_rounds": 0},
        "coordination_state": {"coordinator_rounds": 0, "safety_rounds": 0, "rollback_rounds": 0}, "execution_state": {}, "final_decision": "", "case_status": "running",
    }


def merged(state: dict, change: Mapping[str, object]) -> dict:
    """A step's change: parts of the state are merged, anything else is replaced."""
    out = dict(state)
    for key, value in change.items():
        out[key] = {**out[key], **value} if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


class CaseRunner:
    """``route`` names the next step from (step, state); ``waits`` are steps that a person has to let pass."""

    def __init__(self, steps: Mapping[str, Step], route: Callable[[str, dict], str], checkpoints: Checkpoints | None = None, waits: tuple[str, ...] = (), settings: Mapping[str, object] | None = None, most: int = 100):
        self.steps, self.route, self.checkpoints, self.waits, self.most = steps, route, checkpoints, waits, most
        self.signature = signature(steps, settings or {})

    def run(self, thread: str, first: str, state: dict, on_step: Callable[[str, dict], None] | None = None) -> Iterator[tuple[str, dict]]:
        """(step, state after it) one by one, from ``first`` on. It stops before a step that waits; ``resume`` goes on from there."""
        yield from self._go(thread, first, state, on_step, None)

    def resume(self, thread: str, change: Mapping[str, object] | None = None, on_step: Callable[[str, dict], None] | None = None) -> Iterator[tuple[str, dict]]:
        """Goes on where the thread stopped, with a person's ``change`` to the state; LookupError where there is nothing to resume."""
        held = self.checkpoints.load(thread, self.signature) if self.checkpoints else None
        if held is None:
            raise LookupError(f"nothing to resume for {thread}")
        node, state = held
        yield from self._go(thread, node, merged(state, change or {}), on_step, node)

    def _go(self, thread, node, state, on_step, passed) -> Iterator[tuple[str, dict]]:
        for _ in range(self.most):
            if node == END:
                if self.checkpoints:
                    self.checkpoints.clear(thread)
                return
            if node in self.waits and node != passed:
                return
            passed = None
            state = merged(state, self.steps[node](state))
            done, node = node, self.route(node, state)
            if self.checkpoints:
                self.checkpoints.save(thread, node, state, self.signature)
            if on_step:
                on_step(done, state)
            yield done, state
        raise RuntimeError(f"{thread} took over {self.most} steps")
