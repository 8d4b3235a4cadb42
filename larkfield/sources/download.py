"""Driver-side fetching: retries, whole-file replacement and shard lists. ``opener`` is any function url -> bytes."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable


class HttpError(OSError):
    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


def get_bytes(url: str, opener: Callable[[str], bytes], tries: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Tries again, with growing pauses, after 429 and network errors only; any other HTTP code fails at once."""
    for k in range(tries):
        try:
            return opener(url)
        except HttpError as bad:
            if bad.code != 429 or k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        sleep(pause * 2**k)
    raise AssertionError


def download(url: str, path: str, opener: Callable[[str], bytes], complete: Callable[[str], bool] | None = None) -> str:
    """A file that is there and not empty stays; a new one appears under its name only when it is whole.

    ``complete`` judges the new file; one that fails leaves an old file as it was.
    """
    if os.path.exists(path) and os.path.getsize(path) > 0 and (complete is None or complete(path)):
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = path + ".part"
    try:
        with open(part, "wb") as f:
            f.write(get_bytes(url, opener))
        if complete is not None and not complete(part):
            raise OSError(f"{url} is not complete")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def first_endpoint(paths: Iterable[str], endpoints: Iterable[str], opener: Callable[[str], bytes]) -> bytes:
    """The first endpoint that answers, mirrors first."""
    last: OSError | None = None
    for base in endpoints:
        for path in paths:
            try:
                return get_bytes(base.rstrip("/") + path, opener)
            except OSError as bad:
                last = bad
    raise OSError("no endpoint answered") from last


def parquet_urls(listing: bytes, config: str, split: str) -> list[str]:
    """Shard urls of one config and split from a JSON listing {config: {split: [url, ...]}} or {"parquet_files": [...]}."""
    data = json.loads(listing)
    if "parquet_files" in data:
        return [f["url"] for f in data["parquet_files"] if f["config"] == config and f["split"] == split]
    return list(data.get(config, {}).get(split, []))
