"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of whole documents inside one task. Its words become numbers (0 for a word that no
benchmark item has), and all of its suffixes are sorted word by word, as far as an item could match: the
shard's suffix array. Every suffix of every item is binary-searched in it; its neighbours there give the
longest verbatim match and its place, and those that reach a window all places of the window. No shuffle
is needed; what is broadcast is one block of items of at most ``BLOCK_CHARS`` characters (or one item).
Each block is one more pass over the same rows, whose answers so far are then in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkfield.llm import kernels
from larkfield.runtime import Scratch, read_table, ship_package

WINDOW = 10
BLOCK_CHARS = 32 << 20
SHARD_BYTES = 6 << 20


class TestSide:
    """The items of one block as numbers, with their windows. Items of one text are matched once; ``ids`` has all of theirs."""

    def __init__(self, ids: list, texts: list, window: int):
        by_text: dict[str, list] = {}
        for i, text in zip(ids, texts, strict=True):
            by_text.setdefault(text, []).append(i)
        ids, texts = [sorted({i for i in x if i is not None}) for x in by_text.values()], list(by_text)
        raw, offsets = kernels.string_views(pa.array(texts, pa.large_string()))
        h, _, _, first = kernels.hash_words(raw, offsets, kernels.ALNUM_WORDS)
        self.window = window
        self.vocabulary = np.unique(h)
        n = len(self.vocabulary) + 1
        words = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
        length = np.diff(first)
        self.depth = int(length.max()) if len(length) else 0
        item = np.repeat(np.arange(len(texts)), length)
        left = np.repeat(first[1:], length) - np.arange(len(words))  # words from here to the item's end
        whole = np.repeat(length, length)
        self.words = np.concatenate([words, np.full(self.depth + 2, -1, np.int64)])
        self.at, self.left, self.item = np.arange(len(words)), left, item
        #: words of a window from each suffix on: none where the item ends before
        self.size = np.where(left >= np.minimum(window, whole), np.minimum(window, whole), 0)
        self.start = first[:-1][item] if len(item) else item
        self.ids = ids
        self.base = n


def suffix_array(words: np.ndarray, pos: np.ndarray, base: int, depth: int) -> np.ndarray:
    """``pos`` in the order of the words that follow, to ``depth`` words or to the first 0, which ends any match.

    ``words`` has ``depth`` + 2 zeros at its end.
    """
    key = words[pos] * base + words[pos + 1]
    order = np.argsort(key)
    pos, key = pos[order], key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(pos)]
    tied = np.flatnonzero(~new | ~np.r_[new[1:], True][: len(pos)])
    tied = tied[key[tied] % base != 0]
    for j in range(2, depth, 2):
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = words[pos[tied] + j] * base + words[pos[tied] + j + 1]
        order = np.lexsort((key, group))
        pos[tied], key = pos[tied][order], key[order]
        step = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        new[tied] |= step
        tied = tied[(~step | ~np.r_[step[1:], True]) & (key % base != 0)]
    return pos


def _bound(words, sa, test, at, size, upper: bool) -> np.ndarray:
    """First place in the suffix array that is not before (or, upper, after) the first ``size`` words of each test suffix."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        order = np.zeros(len(open_), np.int8)
        live = np.arange(len(open_))
        j = 0
        while len(live):
            q = open_[live]
            d = words[sa[mid[live]] + j] - test[at[q] + j]
            order[live] = np.sign(d)
            j += 1
            live = live[(d == 0) & (size[q] > j)]
        right = (order < 0) | (order == 0) if upper else order < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def _shared(words, place, test, at, left) -> np.ndarray:
    """Words that the shard from each place on and the test from ``at`` on have in common, ``left`` at most; 0 for place -1."""
    n = np.zeros(len(at), np.int64)
    live = np.flatnonzero((place >= 0) & (left > 0))
    while len(live):
        live = live[words[place[live] + n[live]] == test[at[live] + n[live]]]
        n[live] += 1
        live = live[left[live] > n[live]]
    return n


def longest_matches(words: np.ndarray, sa: np.ndarray, test: TestSide):
    """(words, place in the shard) of the longest verbatim match of every test suffix; place -1 for none."""
    after = _bound(words, sa, test.words, test.at, test.left, False)
    best, where = np.zeros(len(after), np.int64), np.full(len(after), -1, np.int64)
    for k in (after - 1, after):
        inside = (k >= 0) & (k < len(sa))
        place = np.where(inside, sa[np.clip(k, 0, len(sa) - 1)], -1) if len(sa) else where
        n = _shared(words, place, test.words, test.at, test.left)
        where, best = np.where(n > best, place, where), np.maximum(best, n)
    return best, where


def shard_matches(words: np.ndarray, test: TestSide):
    """(place, window's words, test suffix, longest) of every window that occurs in a shard's padded words.

    longest is the length of the verbatim match from there on.
    """
    none = np.zeros(0, np.int64)
    if not len(test.at):
        return none, none, none, none
    sa = suffix_array(words, np.arange(len(words) - test.depth - 2), test.base, test.depth)
    best, _ = longest_matches(words, sa, test)
    found = np.flatnonzero((test.size > 0) & (best >= test.size))
    lo = _bound(words, sa, test.words, test.at[found], test.size[found], False)
    n = _bound(words, sa, test.words, test.at[found], test.size[found], True) - lo
    which = np.repeat(found, n)
    place = sa[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    return place, test.size[which], which, _shared(words, place, test.words, test.at[which], test.left[which])


def _scan(test: TestSide, text_at: int, width: int):
    """Adds this block's matches to the rows' last columns: words, hit bits, matches, longest match."""

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, batch.schema.names[text_at], SHARD_BYTES):
                raw, offsets = kernels.string_views(part.column(text_at))
                h, _, _, first = kernels.hash_words(raw, offsets, kernels.ALNUM_WORDS)
                rows = part.num_rows
                slot = np.searchsorted(test.vocabulary, h)
                ids = np.zeros(len(h), np.int64)
                if len(test.vocabulary):
                    fits = test.vocabulary[np.minimum(slot, len(test.vocabulary) - 1)] == h
                    ids[fits] = slot[fits] + 1
                row = np.repeat(np.arange(rows), np.diff(first))
                words = np.zeros(len(h) + rows + test.depth + 2, np.int64)  # a zero after each row ends its last match
                words[np.arange(len(h)) + row] = ids
                place, length, which, longest = shard_matches(words, test)
                start = first[:-1] + np.arange(rows)
                of = np.searchsorted(start, place, "right") - 1
                hit = np.zeros(len(words) + 1, np.int64)
                np.add.at(hit, place, 1)
                np.add.at(hit, place + length, -1)
                hit = np.cumsum(hit) > 0
                most = np.zeros(rows, np.int64)
                np.maximum.at(most, of, longest)
                found: dict[int, dict] = {}
                for r, at, k, n in zip(of.tolist(), place.tolist(), which.tolist(), longest.tolist(), strict=True):
                    item, mine = int(test.item[k]), found.setdefault(r, {})
                    match = (-n, int(at - start[r]), int(k - test.start[k]))
                    if match < mine.get(item, (1,)):
                        mine[item] = match
                bits_was, matches_was, most_was = (part.column(width + k).to_pylist() for k in (1, 2, 3))
                bits, matches = [], []
                for r in range(rows):
                    if r in found:
                        n = int(first[r + 1] - first[r])
                        now = np.packbits(hit[start[r] : start[r] + n])
                        bits.append((now | np.frombuffer(bits_was[r], np.uint8)).tobytes() if bits_was[r] else now.tobytes())
                        all_of = {i: match for item, match in found[r].items() for i in test.ids[item]}
                        for m in matches_was[r] or ():
                            all_of[m["item"]] = min(all_of.get(m["item"], (1,)), (-m["words"], m["at"], m["item_at"]))
                        matches.append([{"item": i, "at": a, "item_at": b, "words": -n} for i, (n, a, b) in sorted(all_of.items())])
                    else:
                        bits.append(bits_was[r])
                        matches.append(matches_was[r])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:width],
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(bits, pa.binary()),
                        pa.array(matches, pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]))),
                        pa.array(np.maximum(most, np.array(most_was, np.int64)), pa.int64()),
                    ],
                    names=batch.schema.names,
                )

    return run


_MATCHES = T.ArrayType(T.StructType().add("item", "string").add("at", "long").add("item_at", "long").add("words", "long"))


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with a struct ``match`` (or ``match_1``, ... where docs has that name) at the end.

    match holds n_words, hit (a bit for each word of the text), items (ids as strings, sorted), matches (for
    each of them the longest verbatim match: item, at and item_at, the words before it in text and item, and its
    words), longest (words of the longest of all). Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
    lower-casing A-Z. A window is ``window`` consecutive words of an item, or all of a shorter one. A null
    or wordless text has no words and no match; an item without words matches nothing; an item with a
    null id marks words but is not listed; items that repeat count once. Empty tables are fine.
    """
    ship_package(docs.sparkSession)
    extra = T.StructType().add("lf_n", "long").add("lf_hit", "binary").add("lf_items", _MATCHES).add("lf_long", "long")
    names = [f"c{i}" for i in range(len(docs.columns))]
    types = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    text_at = docs.columns.index(text_col)
    out = docs.toDF(*names).withColumn(names[text_at], F.col(names[text_at]).cast("string"))
    types.fields[text_at].dataType = T.StringType()
    out = out.select("*", F.lit(0).cast("long").alias("lf_n"), F.lit(None).cast("binary").alias("lf_hit"),
                     F.array().cast(_MATCHES).alias("lf_items"), F.lit(0).cast("long").alias("lf_long"))
    scratch = Scratch(docs.sparkSession, "matches")
    for k, test in enumerate(test_blocks(benchmark, item_col, item_text_col, window)):
        out = scratch.save(out, "blocks") if k else out  # so the driver holds one block at a time
        out = out.mapInArrow(kernels.tidied(_scan(test, text_at, len(names))), T.StructType(types.fields + extra.fields))
    k, name = 0, "match"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"match_{k + 1}"
    match = F.struct(F.col("lf_n").alias("n_words"), F.col("lf_hit").alias("hit"), F.transform("lf_items", lambda m: m["item"]).alias("items"), F.col("lf_items").alias("matches"), F.col("lf_long").alias("longest"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], match.alias(name))


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """The items, a block at a time; a block, not the whole table, is what the driver and one broadcast may hold."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).where("t is not null").collect()
        yield TestSide([r.i for r in rows], [r.t for r in rows], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no window of an item occurs in, with their columns as they were."""
    marked = benchmark_matches(docs, benchmark, **options)
    return marked.where(F.col(marked.columns[-1])["longest"] == 0).select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = benchmark_matches(docs, read_table(spark, sf_dir, "benchmark"))
    m = F.col("match")
    n_hit = F.coalesce(F.bitmap_count(m["hit"]), F.lit(0))
    return marked.select(
        "doc_id", m["n_words"].alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(m["items"]), ","), 256).alias("items_sha256"),
        (m["longest"] > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(1, CAST(len(ws) - least(10, len(ws)) + 2 AS BIGINT))) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT l FROM v),
d AS (
  SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, ws, l, unnest(range(1, CAST(len(ws) - l + 2 AS BIGINT))) AS i FROM w, l WHERE len(ws) >= l)),
m AS (SELECT d.doc_id, d.i, d.l, v.item_id FROM d JOIN v ON d.l = v.l AND d.g = v.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.s, sha256('')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
