"""Merkle manifest of a dataset by Pregel-style supersteps over RDDs.

Rows become leaves, numbered within their tree by a range-partitioned sort. A vertex holds a run of ``FAN`` nodes of
one level: its children message it upward, and once all have come it hashes the levels of its run and forwards its
top. The tops of trees are the leaves of one more tree, whose top is the root. Reverse supersteps then send every
vertex the siblings on its way to the root, down to the leaves, which fold their path to the root again.

A vertex gets at most FAN messages up and one down, whatever the trees' sizes, so a tree that holds a third of all rows
is spread like any other. A path meets its leaf inside the leaf's own vertex: what is shuffled is each leaf once,
and a path for every FAN leaves.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from larkfield.runtime import Scratch, read_table, ship_package

#: levels that a vertex holds, and the nodes of its lowest one
LEVELS = 8
FAN = 1 << LEVELS
#: vertices that one task of a superstep should have at least
VERTICES = 16


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> tuple[DataFrame, int, int]:
    """``rows`` with ``lf_at`` (from 0 within ``tree``, by ``order``, nulls first) and ``lf_n`` (rows of the tree); all rows, rows of the largest tree.

    Rows that are equal in tree and order stand next to each other, in the order of their place in the input.
    """
    last = F.monotonically_increasing_id()  # copies of one row are dealt as well
    dealt = rows.withColumn("lf_copy", last).repartitionByRange(tree, *order, "lf_copy").sortWithinPartitions(tree, *order, "lf_copy").drop("lf_copy")
    held = scratch.save(dealt.withColumn("lf_place", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("lf_place", 33)
    runs = held.groupBy(tree, task.alias("lf_task")).agg(F.count("*").alias("lf_rows"), F.min("lf_place").alias("lf_first"))
    # a tree has a row for each task here
    before = Window.partitionBy(tree).orderBy("lf_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(runs.select(
        F.col(tree).alias("lf_tree"), "lf_task", "lf_first", F.coalesce(F.sum("lf_rows").over(before), F.lit(0)).alias("lf_before"),
        F.sum("lf_rows").over(Window.partitionBy(tree)).alias("lf_n"), "lf_rows",
    ), "starts")
    total, largest = starts.agg(F.coalesce(F.sum("lf_rows"), F.lit(0)), F.coalesce(F.max("lf_n"), F.lit(0))).first()
    out = held.join(starts, (held[tree] == starts["lf_tree"]) & (task == starts["lf_task"]))
    at = F.col("lf_place") - F.col("lf_first") + F.col("lf_before")
    return out.select(*[held[c] for c in rows.columns], at.alias("lf_at"), "lf_n"), total, largest


def _levels(low: list[str], top: bool) -> list[list[str]]:
    """The levels of a vertex above its nodes, to the top of the tree or its own."""
    out = [low]
    while len(out[-1]) > 1 or (not top and len(out) <= LEVELS):
        now = out[-1]
        out.append([digest("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return out


def _way(levels: list[list[str]], at: int) -> list[tuple[str, bool]]:
    """(sibling or '', whether it is on the left) from a vertex' node up to its top."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((level[other] if other < len(level) else "", bool(at & 1)))
        at >>= 1
    return out


def fold(leaf: str, way: list[tuple[str, bool]]) -> str:
    for other, left in way:
        leaf = digest(other + leaf if left else leaf + other)
    return leaf


class Forest:
    """All trees over leaves of (tree, place, rows of the tree, digest, anything), level by level."""

    def __init__(self, leaves: RDD, total: int, largest: int, width: int):
        """``width`` is the most partitions that a superstep has."""
        self.steps: list[RDD] = []
        children = leaves.map(lambda x: ((x[0], x[1] >> LEVELS), (x[1] & (FAN - 1), x[2], x[3], x[4])))
        self.tops: RDD | None = None
        while True:
            total, parts = -(-total // FAN), min(width, max(1, -(-total // FAN) // VERTICES))
            # every vertex gets at most FAN messages, so a list of them is bounded
            vertices = children.combineByKey(lambda c: [c], _add, _all, parts).mapValues(lambda v: sorted(v, key=lambda c: c[0]))
            self.steps.append(vertices)
            sent = vertices.map(_forward)
            done = sent.filter(lambda x: x[1] is None).map(lambda x: x[2])
            self.tops = done if self.tops is None else self.tops.union(done)
            if largest <= FAN:
                return
            largest = -(-largest // FAN)
            children = sent.filter(lambda x: x[1] is not None).map(lambda x: (x[1], x[2]))

    def down(self, above: RDD) -> RDD:
        """(tree, node's place, digest, anything, top, way) of all leaves; ``above`` has (tree, (top, way)) from the trees' tops on."""
        ways = above.map(lambda x: ((x[0], 0), (*x[1], True)))
        for k in range(len(self.steps) - 1, -1, -1):
            vertices = self.steps[k]
            met = vertices.cogroup(ways, vertices.getNumPartitions()).flatMap(_spread)
            if not k:
                return met.map(lambda x: (x[0][0], *x[1]))
            # a tree that ends at a lower level keeps its message for that level
            waiting = met.filter(lambda x: x[1][0] is None).map(lambda x: (x[0], x[1][1]))
            ways = met.filter(lambda x: x[1][0] is not None).map(lambda x: ((x[0][0], x[1][0]), (x[1][3], x[1][4], False))).union(waiting)
        raise AssertionError


def _add(held: list, child) -> list:
    held.append(child)
    return held


def _all(a: list, b: list) -> list:
    a.extend(b)
    return a


def _forward(vertex):
    """(tree, vertex above or None, message): the top of a tree, or of a vertex for the one above."""
    (tree, at), children = vertex
    n = children[0][1]
    top = _levels([c[2] for c in children], n <= FAN)[-1][0]
    if n <= FAN:
        return tree, None, (tree, top)
    return tree, (tree, at >> LEVELS), (at & (FAN - 1), -(-n // FAN), top, None)


def _spread(met):
    """What a vertex sends down to each of its nodes: (key, (place, digest, anything, top, way)); an unmet message waits."""
    (tree, at), (vertex, ways) = met
    ways, found = list(ways), False
    for children in vertex:
        ends = children[0][1] <= FAN
        for top, way, fresh in ways:
            if fresh and not ends:
                continue  # the tree's top is further up: this vertex hears from there
            found = True
            levels = _levels([c[2] for c in children], ends)
            for place, _, digest_, more in children:
                yield (tree, at), (at * FAN + place, digest_, more, top, _way(levels, place) + way)
    if not found:
        for message in ways:
            yield (tree, at), (None, message, None, None, None)


def manifest(rows: DataFrame, tree: str, order: list[str], leaf_col: str, checked_col: str, keep: list[str], scratch: Scratch) -> DataFrame:
    """(``keep``, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``tree`` is a non-null string by which the trees are ordered, bytewise; ``leaf_col`` a row's digest, ``checked_col``
    the one that is folded up its path. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    types = {f.name: f.dataType for f in rows.schema.fields}
    out_type = T.StructType([T.StructField(c, types[c]) for c in keep])
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        out_type = out_type.add(name, "string")
    out_type = out_type.add("verified", "boolean")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, total, largest = numbered(rows, tree, order, scratch)
    if not total:
        return spark.createDataFrame([], out_type)
    leaves = at.select(tree, "lf_at", "lf_n", leaf_col, checked_col, *keep).rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], *r[5:])))
    forest = Forest(leaves, total, largest, width)
    tops = spark.createDataFrame(forest.tops, T.StructType().add("name", "string").add("top", "string")).withColumn("all", F.lit(""))
    over, n_tops, _ = numbered(tops, "all", ["name"], scratch)
    upper = Forest(over.select("all", "lf_at", "lf_n", "top", "name").rdd.map(tuple), n_tops, n_tops, width)
    root = upper.tops.map(lambda x: (x[0], (x[1], [])))
    ways = upper.down(root).map(lambda x: (x[3], ((x[4], x[2]), x[5])))  # (tree, ((root, subroot), way))

    def row(x):
        _, _, own, (checked, *kept), (top, sub), way = x
        folded = fold(checked, way)
        return (*kept, own, sub, top, digest("".join(other for other, _ in way)), folded, folded == top)

    return spark.createDataFrame(forest.down(ways).map(row), out_type, verifySchema=False)


def sealed(docs: DataFrame, scratch: Scratch | None = None, id_col: str = "doc_id", tree_col: str = "lang", count_col: str = "n_chars", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> DataFrame:
    """A manifest of ``docs``: a leaf a row over ``fields``, a tree a value of ``tree_col`` (null first), leaves by ``id_col``.

    Where ``tampered`` holds, ``count_col`` is one higher when the leaf is folded up its path, so its proof must fail;
    a null count stays null, and that proof holds. Null ids come first, rows of one id by their digest; equal rows are
    leaves of their own. Texts count whole, at any length. An empty table gives no rows; other columns don't matter.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    c = {f: F.col(f) for f in fields}
    own = leaf(*c.values())
    other = own if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf(*({**c, count_col: F.col(count_col) + 1}).values())).otherwise(own)
    tree = F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    rows = docs.select(F.col(id_col), tree.alias("lf_name"), own.alias("lf_leaf"), other.alias("lf_checked"))
    return manifest(rows, "lf_name", [id_col, "lf_leaf"], "lf_leaf", "lf_checked", [id_col], scratch)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return sealed(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


#: levels as lists: each level of a tree is one row
OP11_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list_reduce(range(0, 8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c, i FROM (SELECT unnest(range(0, 256)) AS i) t),
crcs AS (SELECT list(c ORDER BY i) AS t FROM crc),
d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS s FROM documents),
h AS (
  SELECT r, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS b,
    xor(list_reduce(list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda q, x: xor(q >> 8, t[CAST(xor(q & 255, x) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS bad
  FROM d, crcs),
l AS (
  SELECT r, doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf,
    sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || b) AS other, coalesce(bad, false) AS bad FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM k GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tree WHERE len(nodes) > 1),
sub AS (SELECT lang, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM top WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root, level AS depth FROM top WHERE len(nodes) = 1),
way AS (
  SELECT k.r, t.level, (k.pos >> t.level) % 2 = 1 AS on_left, coalesce(t.nodes[xor(k.pos >> t.level, 1) + 1], '') AS sibling
  FROM k JOIN tree t ON t.lang IS NOT DISTINCT FROM k.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT k.r, s.depth + t.level, (s.place >> t.level) % 2 = 1, coalesce(t.nodes[xor(s.place >> t.level, 1) + 1], '')
  FROM k JOIN sub s ON s.lang IS NOT DISTINCT FROM k.lang, top t WHERE len(t.nodes) > 1),
ways AS (SELECT r, list({'l': on_left, 's': sibling} ORDER BY level) AS w, string_agg(sibling, '' ORDER BY level) AS proof FROM way GROUP BY r),
f AS (
  SELECT k.r, 1 AS step, CASE WHEN bad THEN other ELSE leaf END AS h FROM k
  UNION ALL
  SELECT f.r, step + 1, CASE WHEN w[step].l THEN sha256(w[step].s || h) ELSE sha256(h || w[step].s) END FROM f JOIN ways ON ways.r = f.r WHERE step <= len(w)),
e AS (SELECT r, arg_max(h, step) AS h FROM f GROUP BY r)
SELECT k.doc_id, k.leaf, s.subroot, root.root, sha256(coalesce(ways.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM k JOIN sub s ON s.lang IS NOT DISTINCT FROM k.lang JOIN e ON e.r = k.r LEFT JOIN ways ON ways.r = k.r, root
"""
