"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

A document is the set of its distinct five-word shingles. Documents with the same set form one class
at once, whatever the size of the group. Classes get 64 symbols of 16 bits (b-bit MinHash). Pigeonhole:
for a distance limit of d symbols, all 64 are cut into d // 2 + 1 chunks, so that some chunk has at most
one error, and each chunk is keyed once per position with that position left out. All pairs under the
signature distance share such a key. Candidates are confirmed on the full shingle sets:

1. under each key every class proposes its nearest signature; confirmed links give components;
2. classes that are near under some key, but in different components, form clusters; each cluster's sets
   meet in units of two blocks, where every near pair across components is counted in memory.

Pairs inside a component need no test, as they can't change the result. So a group of thousands of
copies costs about a link for each member, no row is made for a pair that isn't a link, and no link
between different texts that matters is lost. A key of many members is peeled: one block of members meets
all others, confirmed links merge them, and only what is left outside of the key's largest component
leads the next round. The members of that component never meet each other again, so the rows that move
grow with the members, and with the square only of those that no link ties to the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkfield.llm import kernels
from larkfield.operators.components import connected_components
from larkfield.runtime import Scratch, read_table, ship_package

SHINGLE = 5
SYMBOLS = 64
#: rows of a unit whose pairs are laid out one after the other; larger units are matrices
SMALL = 8
#: members of a block of one key, whose signatures meet another block's in one unit
BLOCK = 4096
#: members of a block whose full sets meet in one unit
SETS = 512
#: proposals of one nearest class that are confirmed in one unit
PROPOSALS = 64
#: bytes of the bit matrix that a unit counts shared shingles with; beyond, sets are intersected pair by pair
BITS = 96 << 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < SHINGLE:
        return np.array([kernels.hash_sequence(h)], np.uint64)
    return np.unique(kernels.hash_windows(h, SHINGLE))


def signature(s: np.ndarray) -> bytes:
    """64 symbols: 16 bits of the least value of each multiply-add hash over the set."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (kernels.splitmix(low) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def class_id(s: np.ndarray, seed: int = 0x5BD1E995) -> int:
    """One 64-bit name for equal sets."""
    total = np.sum(kernels.splitmix(s ^ np.uint64(seed)), dtype=np.uint64)
    return int(kernels.splitmix(np.array([total ^ np.uint64(len(s))]))[0].view(np.int64))


def most_distance(percent: int, deviations: float = 4.5) -> int:
    """Signature distance that a pair of that similarity exceeds, by default, once in a hundred thousand times."""
    p = 1 - percent / 100
    return min(SYMBOLS - 1, int(np.ceil(SYMBOLS * p + deviations * np.sqrt(SYMBOLS * p * (1 - p)))))


def chunks(limit: int) -> list[tuple[int, int]]:
    """(start, size) of the chunks; ``limit`` errors can't put two into each."""
    edges = np.linspace(0, SYMBOLS, limit // 2 + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _features(batches):
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            raw, offsets = kernels.string_views(part.column(1))
            h, _, _, first = kernels.hash_words(raw, offsets, kernels.SPACE_WORDS)
            n, cid, chk, sig = [], [], [], []
            for i in range(part.num_rows):
                s = shingle_set(h[first[i] : first[i + 1]])
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                chk.append(class_id(s, 0x2545F491) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(chk, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "cid", "chk", "sig"],
            )


def _sets(batches):
    """(cid, set) of the rows whose text gives the wanted class: an id that repeats may carry other texts as well."""
    for batch in batches:
        for part in kernels.slices(batch, "text"):
            raw, offsets = kernels.string_views(part.column(1))
            h, _, _, first = kernels.hash_words(raw, offsets, kernels.SPACE_WORDS)
            sets = [shingle_set(h[first[i] : first[i + 1]]) for i in range(part.num_rows)]
            fits = [len(s) > 0 and class_id(s) == c for s, c in zip(sets, part.column(0).to_pylist(), strict=True)]
            sets = [s.tobytes() for s, f in zip(sets, fits, strict=True) if f]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fits)), pa.array(sets, pa.binary())], names=["cid", "shingles"])


def _by_unit(work, names: list[str], rows: int):
    """mapInArrow function: ``work(table)`` gets whole units of a partition sorted by unit, some ``rows`` at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("unit").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last unit may go on in the next batch
            if cut:
                yield _pairs(work(table.slice(0, cut).combine_chunks()), names)
                held = table.slice(cut).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield _pairs(work(pa.Table.from_batches(held).combine_chunks()), names)

    return run


def _pairs(ab, names) -> pa.RecordBatch:
    both = np.unique(np.stack(ab, axis=1), axis=0) if len(ab[0]) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=names)


class _Rows:
    """The columns of some units as arrays, with where each unit begins and ends."""

    def __init__(self, table: pa.Table):
        has = set(table.column_names)
        key = table.column("unit").to_numpy()
        self.cid = table.column("cid").to_numpy()
        self.n = table.column("n_shingles").to_numpy()
        self.blk = table.column("blk").to_numpy()
        self.comp = table.column("comp").to_numpy() if "comp" in has else None
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        self.sets = table.column("shingles") if "shingles" in has else None
        self.begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.end = np.r_[self.begin[1:], len(key)]
        self.cross = np.zeros(len(key), bool)  # a unit of two blocks looks at pairs between them only
        if self.blk.any():
            two = np.minimum.reduceat(self.blk, self.begin) != np.maximum.reduceat(self.blk, self.begin)
            self.cross = np.repeat(two, self.end - self.begin)

    def near(self, i, j, percent: int, limit: int):
        """The pairs under the signature distance that may be similar enough and are of this unit: (i, j, distance)."""
        n = self.n
        keep = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        if self.comp is not None:
            keep &= self.comp[i] != self.comp[j]
        keep &= (self.blk[i] != self.blk[j]) | ~self.cross[i]
        i, j = i[keep], j[keep]
        d = (self.sig[i] != self.sig[j]).sum(axis=1)
        keep = d <= limit
        return i[keep], j[keep], d[keep]

    def matrix(self, lo: int, hi: int, percent: int, limit: int):
        """(first row, distances of some rows to all of the unit): FAR where a pair isn't near; some 400,000 pairs at a time."""
        sig, n, size = np.ascontiguousarray(self.sig[lo:hi].T), self.n[lo:hi], hi - lo
        comp, blk = self.comp[lo:hi] if self.comp is not None else None, self.blk[lo:hi] if self.cross[lo] else None
        step = max(1, 400_000 // size)
        for at in range(0, size, step):
            some = slice(at, min(size, at + step))
            d = np.zeros((some.stop - at, size), np.uint8)
            for symbol in sig:
                d += symbol[some, None] != symbol
            far = (d > limit) | (100 * np.minimum(n[some, None], n) < percent * np.maximum(n[some, None], n))
            for same in (comp, blk):
                if same is not None:
                    far |= same[some, None] == same
            far[np.arange(len(d)), np.arange(at, some.stop)] = True
            d[far] = FAR
            yield at, d

    def small(self, percent: int, limit: int):
        """Near pairs of all units of at most SMALL rows."""
        size = self.end - self.begin
        few, last = np.repeat(size <= SMALL, size), np.repeat(self.end, size)
        for off in range(1, SMALL):
            at = np.arange(len(few) - off)
            i = at[few[: len(few) - off] & (at + off < last[: len(few) - off])]
            if not len(i):
                return
            yield self.near(i, i + off, percent, limit)

    def large(self):
        size = self.end - self.begin
        return zip(self.begin[size > SMALL].tolist(), self.end[size > SMALL].tolist(), strict=True)


#: in a matrix of distances, a pair that isn't near
FAR = 255


def _joined(out):
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _propose(percent: int):
    """First pass: (row, its nearest signature in the unit); likely links only, as the second pass takes all.

    Of several that are as near, the smallest class, so that a row proposes the same one under most of its keys.
    """
    limit = most_distance(percent, 1.0)

    def work(table: pa.Table):
        rows = _Rows(table)
        out = []
        if few := list(rows.small(percent, limit)):
            i, j, d = (np.concatenate(x) for x in zip(*few, strict=True))
            i, j, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
            order = np.lexsort((rows.cid[j], d, i))
            i, j = i[order], j[order]
            first = np.r_[True, i[1:] != i[:-1]][: len(i)]
            out.append((i[first], j[first]))
        for lo, hi in rows.large():
            by_cid = np.argsort(rows.cid[lo:hi])
            for at, d in rows.matrix(lo, hi, percent, limit):
                best = by_cid[d[:, by_cid].argmin(axis=1)]
                some = np.flatnonzero(d[np.arange(len(d)), best] < FAR)
                out.append((lo + at + some, lo + best[some]))
        i, j = _joined(out)
        return rows.cid[i], rows.cid[j]

    return _by_unit(work, ["a", "b"], 20_000)


def _join_near(percent: int):
    """Second pass: ties the rows of a unit that near pairs across components connect, by a star each."""
    limit = most_distance(percent)

    def work(table: pa.Table):
        rows = _Rows(table)
        out = [(i, j) for i, j, _ in rows.small(percent, limit)]
        for lo, hi in rows.large():
            touch = np.concatenate([d < FAR for _, d in rows.matrix(lo, hi, percent, limit)])
            todo = touch.any(axis=1)
            while todo.any():
                first = int(todo.argmax())
                group = np.zeros(hi - lo, bool)
                edge = np.array([first])
                group[first] = True
                while len(edge):
                    new = touch[edge].any(axis=0) & ~group
                    group |= new
                    edge = np.flatnonzero(new)
                todo &= ~group
                rest = np.flatnonzero(group)
                least = rest[rows.cid[lo + rest].argmin()]
                rest = rest[rest != least]
                out.append((np.full(len(rest), lo + least), lo + rest))
        i, j = _joined(out)
        return rows.cid[i], rows.cid[j]

    return _by_unit(work, ["a", "b"], 20_000)


def _settle(percent: int):
    """Second pass: counts the shared shingles of every near pair across components of a unit; a link for each two components."""
    limit = most_distance(percent)

    def links(rows: _Rows, i, j):
        """Which of the pairs, of one unit, are links."""
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = [np.frombuffer(rows.sets[int(r)].as_py(), np.uint64) for r in used]
        x, y = back[: len(i)], back[len(i) :]
        size = np.array([len(s) for s in sets])
        values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        width = -(-int((count > 1).sum()) // 8)
        both = np.zeros(len(i), np.int64)
        if width * len(sets) <= BITS:
            bits = np.zeros((len(sets), max(width, 1)), np.uint8)
            owner = np.repeat(np.arange(len(sets)), size)
            shared = count[at] > 1
            owner, column = owner[shared], place[at[shared]]
            np.bitwise_or.at(bits, (owner, column >> 3), (1 << (column & 7)).astype(np.uint8))
            step = max(1, (4 << 20) // max(width, 1))
            for k in range(0, len(i), step):
                both[k : k + step] = np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(axis=1, dtype=np.int64)
        else:
            for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                both[k] = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        return 100 * both >= percent * (size[x] + size[y] - both)

    def work(table: pa.Table):
        rows = _Rows(table)
        out = []
        for lo, hi in zip(rows.begin.tolist(), rows.end.tolist(), strict=True):
            if hi - lo < 2:
                continue
            near = [np.nonzero(d < FAR) + (at,) for at, d in rows.matrix(lo, hi, percent, limit)]
            i, j = np.concatenate([lo + at + i for i, _, at in near]), np.concatenate([lo + j for _, j, _ in near])
            i, j = i[i < j], j[i < j]
            if len(i):
                yes = links(rows, i, j)
                i, j = i[yes], j[yes]
                a, b = np.minimum(rows.comp[i], rows.comp[j]), np.maximum(rows.comp[i], rows.comp[j])
                _, one = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
                out.append((i[one], j[one]))
        i, j = _joined(out)
        return rows.cid[i], rows.cid[j]

    return _by_unit(work, ["a", "b"], 1_000)


def _confirm(percent: int):
    """Pairs of each unit whose full sets are similar enough; rows are sorted by unit with sets first."""

    def unit_links(rows):
        sets = {c: np.frombuffer(s, np.uint64) for c, s, b in rows if s is not None}
        for a, s, b in rows:
            if s is None:
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yield a, b

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            out = []
            for u, a, s, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if u != unit:
                    out += unit_links(rows)
                    unit, rows = u, []
                rows.append((a, s, b))
            yield _links(out)
        yield _links(list(unit_links(rows)))

    return run


def _links(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _keys(classes: DataFrame, limit: int) -> DataFrame:
    """A row for each class and key: one chunk with one symbol left out."""
    out = []
    for at, size in chunks(limit):
        for p in range(at, at + size):
            parts = [F.substring("sig", 2 * at + 1, 2 * (p - at))] if p > at else []
            parts += [F.substring("sig", 2 * p + 3, 2 * (at + size - p - 1))] if p < at + size - 1 else []
            out.append(F.xxhash64(F.lit(p), *parts))
    return classes.select("cid", F.explode(F.array(*out)).alias("key"))


def _in_blocks(rows: DataFrame, group: str, lead, leaders, others, block: int) -> DataFrame:
    """Adds blk and unit, a unit for each two blocks that meet.

    The blocks of the ``leaders`` rows where ``lead`` holds meet all blocks; those of the ``others`` meet only them.
    """
    first = F.ceil(leaders / F.lit(block)).cast("int")
    rest = F.ceil(others / F.lit(block)).cast("int")
    place = F.xxhash64("cid", F.lit(group))
    blk = F.when(lead, F.pmod(place, F.greatest(first, F.lit(1)))).otherwise(first + F.pmod(place, F.greatest(rest, F.lit(1)))).cast("int")
    return (
        rows.withColumns({"blk": blk, "last": F.when(lead, first + rest).otherwise(first) - 1})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("unit", F.xxhash64(group, F.least("blk", "other"), F.greatest("blk", "other")))
        .drop("other", "last", group)
    )


def _units(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the shared keys with signatures, each unit's together."""
    return rows.join(classes.select("cid", "n_shingles", "sig"), "cid").repartition("unit").sortWithinPartitions("unit")


def _divided(rows: DataFrame, group: str, block: int, scratch: Scratch) -> DataFrame:
    """Rows (group, cid, comp) of the groups with more than one component, with how to cut them.

    outside counts the members beyond the largest component. lead holds for these, and for all members of a group
    of one block.
    """
    size = rows.groupBy(group, "comp").agg(F.count("*").alias("n")).groupBy(group).agg(
        F.sum("n").alias("members"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main")
    )
    cut = size.where("most < members").select(group, "members", "main", (F.col("members") - F.col("most")).alias("outside"))
    cut = scratch.save(cut, "cut")  # written, so that the join is one that Spark splits where a group is hot
    few = F.col("members") <= block
    return rows.join(cut, group).select(
        group, "cid", "comp", "members", "outside", (few | (F.col("comp") != F.col("main"))).alias("lead"),
        F.when(few, F.col("members")).otherwise(F.col("outside")).alias("leaders"),
    )


def _settled(near: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The links across components in the clusters that ``near`` ties together."""
    rows = connected_components(near, scratch).select(F.col("node").alias("cid"), "root")
    rows = rows.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    rows = _divided(rows, "root", SETS, scratch)
    rows = _in_blocks(rows, "root", F.col("lead"), F.col("leaders"), F.col("members") - F.col("leaders"), SETS)
    rows = rows.select("unit", "cid", "comp", "blk").join(classes.select("cid", "n_shingles", "sig"), "cid").join(sets, "cid")
    rows = rows.repartition("unit").sortWithinPartitions("unit")
    return scratch.save(rows.mapInArrow(kernels.tidied(_settle(percent)), "a long, b long"), "links")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The proposals (a, its nearest b) that are links: a unit for each b, or for some PROPOSALS proposals of one b.

    The set of b travels once to each unit, that of a once for each proposal, of which it makes about one.
    """
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > PROPOSALS).select("b", F.ceil(F.col("n") / PROPOSALS).alias("k"))
    part = F.pmod(F.xxhash64("a"), F.coalesce("k", F.lit(1)))
    units = pairs.join(hubs, "b", "left").select(F.xxhash64("b", part).alias("unit"), "a", "b")
    need = units.select("unit", F.explode(F.array("a", "b")).alias("cid")).distinct()
    rows = need.join(sets, "cid").select("unit", F.col("cid").alias("a"), "shingles", F.lit(None).cast("long").alias("b"))
    rows = rows.unionByName(units.select("unit", "a", F.lit(None).cast("binary").alias("shingles"), "b"))
    rows = rows.repartition("unit").sortWithinPartitions("unit", F.col("b").asc_nulls_first())
    return scratch.save(rows.mapInArrow(kernels.tidied(_confirm(percent)), "a long, b long"), "links")


def _linked(multi: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch):
    """(links, components, rows of the keys that still hold several components) after rounds of proposals.

    Another round follows while some key has more than a block of members outside of its largest component and the
    last round found a link.
    """
    propose = lambda rows: scratch.save(
        _units(rows, classes).mapInArrow(kernels.tidied(_propose(percent)), "a long, b long").distinct(), "pairs"
    )
    leaders = F.least("members", F.lit(BLOCK))
    first_block = lambda of: F.pmod(F.xxhash64("cid"), F.ceil(of / F.lit(BLOCK)).cast("int")) == 0
    rows = _in_blocks(multi, "key", first_block(F.col("members")), leaders, F.col("members") - leaders, BLOCK)
    links = _confirmed(propose(rows.select("unit", "cid", "blk")), sets, percent, scratch)
    while True:
        comps = connected_components(links, scratch).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
        labelled = multi.select("key", "cid").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        mixed = scratch.save(_divided(labelled, "key", BLOCK, scratch), "mixed")
        crowded = mixed.where((F.col("outside") > BLOCK) & (F.col("members") > BLOCK))
        if crowded.isEmpty():
            return links, comps, mixed
        rows = _in_blocks(crowded, "key", F.col("lead") & first_block(F.col("outside")), leaders, F.col("members") - leaders, BLOCK)
        new = _confirmed(propose(rows.select("unit", "cid", "comp", "blk")), sets, percent, scratch)
        if new.isEmpty():
            return links, comps, mixed
        links = links.unionByName(new)


def near_duplicates(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; two sets are linked where 100 times
    the intersection is at least ``percent`` times the union. component_id is the smallest id that
    links reach. A text without words, or null, has an empty set, links with nothing and is kept.
    A text of fewer than five words is one shingle. Rows that repeat an id share its component; a
    null id leads no group: such a row gets a null component and is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(texts.mapInArrow(kernels.tidied(_features), "doc_id long, n_shingles long, cid long, chk long, sig binary"), "features")

    classes = scratch.save(
        rows.where("cid is not null").groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.min("chk").alias("chk"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")
        ),
        "classes",
    )
    keys = _keys(classes.where("rep is not null"), most_distance(percent))
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    multi = scratch.save(keys.join(shared, "key"), "keys")

    wanted = multi.select("cid").distinct().join(classes.select("cid", "rep"), "cid")
    sets = scratch.save(
        texts.join(wanted, texts.doc_id == wanted.rep).select("cid", "text").mapInArrow(kernels.tidied(_sets), "cid long, shingles binary")
        .dropDuplicates(["cid"]),
        "sets",
    )
    links, comps, mixed = _linked(multi, classes, sets, percent, scratch)
    near = _in_blocks(mixed, "key", F.col("lead"), F.col("leaders"), F.col("members") - F.col("leaders"), BLOCK).select("unit", "cid", "comp", "blk")
    near = _units(near, classes).mapInArrow(kernels.tidied(_join_near(percent)), "a long, b long").distinct()
    more = _settled(scratch.save(near, "near"), comps, classes, sets, percent, scratch)

    several = rows.where("cid is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("cid").alias("a"), F.max("cid").alias("z")
    ).where("a != z")  # an id that carries several texts joins their classes
    again = rows.join(several, "doc_id").where("cid != a").select("a", F.col("cid").alias("b"))
    comps = connected_components(links.unionByName(more).unionByName(again), scratch)
    label = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", "rep", F.col("chk").alias("class_chk"), F.coalesce("root", "cid").alias("root")
    )
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    salts = 8  # a class may hold a third of the rows
    label = label.join(least, "root").select("cid", "class_chk", "component_id", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(label, ["cid", "salt"], "left")
    # two sets of the same 64 bits but another 64 that differ are no copies: the greater stays by itself
    component = F.when(F.col("cid").isNull() | (F.col("chk") != F.col("class_chk")), F.col("doc_id")).otherwise(
        F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    )
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


#: exact, by counting shared shingles; the transitive closure by a recursive query
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
      THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
      ELSE [array_to_string(ws, ' ')] END) AS sh
    FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS other FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  CAST(least(d.doc_id, coalesce(m.other, d.doc_id)) AS BIGINT) AS component_id,
  d.doc_id <= coalesce(m.other, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
