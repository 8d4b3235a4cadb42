import json

from larkfield.llm import tool_chat


def msg(conv, turn, role, value):
    return (conv, turn, role, value if isinstance(value, (str, type(None))) else json.dumps(value), "x")


def call(i, name="search", args=None, **more):
    return {"id": i, "name": name, "arguments": {"query": "q"} if args is None else args, **more}


ROWS = [
    msg(1, 0, "user", "hello \"you\"\n{not json"),
    msg(1, 1, "assistant", {"content": "let me see", "tool_calls": [
        call("c", after=["b"]), call("b", "fetch", {"url": "u", "b": [1, {"z": 1, "a": 2}]}, after=["a", "gone"]), call("a", "search", {"limit": 3, "query": "é"})]}),
    msg(1, 2, "tool", {"tool_call_id": "a", "content": "r-a"}),
    msg(1, 3, "tool", {"tool_call_id": "a", "content": "again"}),
    msg(1, 4, "tool", {"tool_call_id": "zzz", "content": "lost"}),
    msg(1, 5, "tool", {"tool_call_id": "b", "content": "r-b"}),
    msg(2, 0, "assistant", {"tool_calls": [call("x", after=["y"]), call("y", after=["x"]), call("w", after=["y"]), call("v")]}),
    msg(2, 1, "assistant", {"tool_calls": [call("v"), call("n", "nope"), call("m", "search", {"limit": 1}), call("t", "search", {"query": 5}), call("o", "search", "text"), call(None)]}),
    msg(2, 2, "tool", {"tool_call_id": "v", "content": "{\"k\": 1}"}),
    msg(3, 0, None, None), msg(3, 1, "user", ""), msg(3, 1, "user", ""), msg(None, None, "user", "no conversation"),
    msg(3, 2, "assistant", "{broken"), msg(3, 3, "user", {"tool_calls": [call("u")]}), msg(3, 4, "user", "long " * 20_000),
]


def brute(rows):
    """The same rules, one conversation at a time."""
    out = []
    parsed = []
    for conv, turn, role, text, _ in rows:
        role, text = role or "", text or ""
        try:
            value = json.loads(text) if text.lstrip().startswith("{") else None
        except ValueError:
            value = None
        calls = value.get("tool_calls") if value and role == "assistant" else None
        result = value if value and role == "tool" and value.get("tool_call_id") is not None else None
        parsed.append((conv, turn, role, text, value, calls, result))
    canonical = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    for conv in {p[0] for p in parsed}:
        own = [p for p in parsed if p[0] == conv]
        calls = sorted([(t, k, c) for _, t, _, _, _, cs, _ in own for k, c in enumerate(cs or [])], key=lambda x: x[:2])
        results = sorted([(t, r) for _, t, *_, r in own if r], key=lambda x: x[0])
        names = {c["id"] for *_, c in calls if c["id"]}
        needs = {i: {a for *_, c in calls if c["id"] == i for a in c.get("after", []) if a in names} for i in names}
        level, k = {}, 0
        while True:
            new = [i for i in needs if i not in level and needs[i] <= set(level)]
            if not new:
                break
            level |= dict.fromkeys(new, k)
            k += 1
        for _, turn, role, text, value, cs, r in own:
            content = (value.get("content") or "") if cs else text
            if not r and not (cs and not content):
                line = {"content": content, "role": role} | ({} if turn is None else {"turn": turn})
                out.append((conv, turn, -1, -1, "message", None, "ok", canonical(line)))
        seen = set()
        first = {}
        for t, r in results:
            status = "orphan" if r["tool_call_id"] not in names else "linked" if r["tool_call_id"] not in first else "repeated"
            first.setdefault(r["tool_call_id"], r["content"])
            out.append((conv, t, -1, -1, "result", r["tool_call_id"], status, canonical({"content": r["content"], "role": "tool", "tool_call_id": r["tool_call_id"], "turn": t})))
        for t, k, c in calls:
            i, args = c["id"], c["arguments"]
            schema = tool_chat.SCHEMAS.get(c["name"])
            why = None
            if not isinstance(args, dict):
                why = "arguments are no object"
            elif schema is None:
                why = "unknown tool"
            else:
                for p, (kind, required) in schema.items():
                    if args.get(p) is None:
                        if required:
                            why = why or f"missing {p}"
                    elif not isinstance(args[p], {"string": str, "integer": int}[kind]):
                        why = why or f"type of {p}"
            again = i in seen
            result = None if again or i is None else first.get(i)
            status = "duplicate" if again else "cycle" if i and i not in level else f"invalid: {why}" if why else "pending" if result is None else "ok"
            seen |= {i} - {None}
            shown = args if isinstance(args, dict) else {"text": args}
            out.append((conv, t, k, level.get(i, 0) if i else 0, "call", i, status, canonical({"arguments": shown, "id": i, "name": c["name"], "result": result, "role": "assistant", "turn": t})))
    return sorted(map(str, out))


def test_same_as_brute_force(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, line string")
    got = tool_chat.format_chat(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS)


def test_order_of_a_conversation(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, x string")
    rows = tool_chat.format_chat(df).where("conv_id = 1").orderBy("turn", "level", "seq").collect()
    assert [r.call_id for r in rows if r.kind == "call"] == ["a", "b", "c"]


def test_round_trip(spark):
    """Every line is JSON, and canonical: writing it again changes nothing."""
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, x string")
    for r in tool_chat.format_chat(df).collect():
        assert json.dumps(json.loads(r.line), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.line


def test_empty(spark):
    assert tool_chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query_keeps_every_message(spark, sf):
    from larkfield.llm import registry

    out = registry.QUERIES["op7_tool_chat"](spark, sf).collect()
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert len(out) == len(rows)
    for r in out:
        m = rows[(r.conv_id, r.turn)]
        assert json.loads(r.line) == {"content": m.text, "role": m.role, "turn": m.turn}


def test_null_conversations_are_ordered_like_others(spark):
    from tests.llm.test_tool_chat import ROWS

    rows = [(None, *r[1:]) for r in ROWS if r[0] == 1]
    schema = "conv_id long, turn long, role string, text string, line string"
    other = sorted((r.turn or 0, r.seq, r.level, r.kind, r.call_id or "", r.status) for r in tool_chat.format_chat(spark.createDataFrame([r for r in ROWS if r[0] == 1], schema)).collect())
    got = tool_chat.format_chat(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.turn or 0, r.seq, r.level, r.kind, r.call_id or "", r.status) for r in got) == other and {r.conv_id for r in got} == {None}


def test_both_ways_of_ordering_agree(spark, monkeypatch):
    """Random constraints with cycles: inside a row, by rounds, and by their definition."""
    import random

    from larkfield.runtime import Scratch

    rng = random.Random(3)
    calls = [(f"c{c}", f"k{k}", [f"k{rng.randrange(n + 1)}" if rng.random() < 0.1 else f"k{rng.randrange(k)}" for _ in range(rng.randrange(3)) if k]) for c in range(30) for n in [rng.choice((1, 4, 9))] for k in range(n)]
    df = spark.createDataFrame(calls, "conv_id string, call_id string, after array<string>")
    few = {tuple(r) for r in tool_chat.levels(df, Scratch(spark, "t")).select("conv_id", "call_id", "level").collect()}
    monkeypatch.setattr(tool_chat, "FEW", 2)
    assert {tuple(r) for r in tool_chat.levels(df, Scratch(spark, "t")).select("conv_id", "call_id", "level").collect()} == few
    after = {(c, k): [x for x in a if (c, x) in {(p, q) for p, q, _ in calls}] for c, k, a in calls}
    level = {}
    for _ in range(20):
        for (c, k), need in after.items():
            if (c, k) not in level and all((c, x) in level for x in need):
                level[(c, k)] = max([level[(c, x)] + 1 for x in need], default=0)
    assert few == {(c, k, level.get((c, k))) for c, k in after}
