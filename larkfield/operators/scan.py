"""Scans of texts for the labels of a large dictionary, with automata.

The dictionary is a table. Where labels have to stand between word boundaries, every word of a label is a word of a text that
holds it. So texts are dealt into blocks, the words of a block meet the labels by their longest word, and a block is read
with the labels that it may hold: the work grows with texts and labels, not with their product.

Labels without a word, and those that may stand inside of words, are dealt into shards by a hash of their first characters, each
of bounded size; a shard is one Aho-Corasick automaton, which finds all of its labels in one reading of a text. Texts
stay where they are: a task builds the automata of the shards that it is sent, and a dictionary of several shards is one
more reading for each, not one for each label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from larkfield.functions.text import normalize
from larkfield.runtime import Scratch, ship_package

#: characters of the labels of one shard, which the driver and one automaton hold at a time
SHARD_CHARS = 1 << 20
#: characters of the texts of one block, but for texts that are longer
BLOCK_CHARS = 1 << 20
#: characters of a label's head, by which it is dealt
HEAD = 2
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_RUN = re.compile("[a-z0-9]+")

_PLACES = T.ArrayType(T.StructType().add("label", "string").add("start", "integer").add("end", "integer"))
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_built: dict[int, object] = {}


def _automaton(labels: tuple[str, ...]):
    """The automaton of some labels; a worker keeps the one it built last."""
    key = hash(labels)
    if key not in _built:
        _built.clear()
        _built[key] = _made(labels)
    return _built[key]


def _made(labels):
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for label in labels:
        made.add_word(label)
    made.make_automaton()
    return made


def places(labels: tuple[str, ...], text: str, bounded: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of every place, overlapping ones too, where the text holds one of the labels.

    With ``bounded`` an edge of a label that is an ASCII letter or digit has none beside it.
    """
    return _places(_automaton(labels), text, bounded)


def _places(automaton, text: str, bounded: bool) -> Iterator[tuple[int, int]]:
    for last, length in automaton.iter(text):
        start, end = last + 1 - length, last + 1
        if bounded:
            if start and text[start] in WORD and text[start - 1] in WORD:
                continue
            if end < len(text) and text[last] in WORD and text[end] in WORD:
                continue
        yield start, end


def leftmost_longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping places the leftmost, of those the longest, and on from its end."""
    out, free = [], 0
    for start, end in sorted(found, key=lambda p: (p[0], -p[1])):
        if start >= free:
            out.append((start, end))
            free = end
    return out


def _scan(labels: tuple[str, ...], bounded: bool):
    """Adds the places of a shard's labels to a row's last column."""

    def run(batches):
        for batch in batches:
            texts, held = batch.column("text").to_pylist(), batch.column("found").to_pylist()
            if labels:
                for i, text in enumerate(texts):
                    if text:
                        held[i] = held[i] + [{"label": text[a:b], "start": a, "end": b} for a, b in places(labels, text, bounded)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, _ARROW)], names=batch.schema.names)

    return run


def _read(labels: list[str], texts: list[str], places_of: list[list[tuple[int, int]]]) -> None:
    """Adds each text's places, between word boundaries, of some labels. Labels of one word are looked up, others have an automaton."""
    words = {x for x in labels if _RUN.fullmatch(x)}
    automaton = _made(rest) if (rest := [x for x in labels if x not in words]) else None
    for text, held in zip(texts, places_of):
        held += [m.span() for m in _RUN.finditer(text) if m.group() in words]
        if automaton is not None and text:
            held += _places(automaton, text, True)


def _read_blocks(batches):
    """Rows of (block, label, row, text, found), a block's texts before its labels, become (row, text, found) with all places in order."""

    def finished(held, texts, places_of):
        at = 0
        for batch in held:
            ends, labels, starts, stops = [0], [], [], []
            for text, was, new in zip(texts[at:], batch.column("found").to_pylist(), places_of[at : at + batch.num_rows]):
                every = sorted(new + [(x["start"], x["end"]) for x in was], key=lambda p: (p[0], -p[1]))
                labels += [text[a:b] for a, b in every]
                starts += [a for a, _ in every]
                stops += [b for _, b in every]
                ends.append(len(starts))
            at += batch.num_rows
            found = pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["label", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["row", "text", "found"])

    block, held, texts, places_of, labels, size = None, [], [], [], [], 0
    for batch in batches:
        ids = batch.column("block").to_pylist()
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if ids[a] != block:
                _read(labels, texts, places_of)
                yield from finished(held, texts, places_of)
                block, held, texts, places_of, labels, size = ids[a], [], [], [], [], 0
            part = batch.slice(a, b - a)
            mine = part.filter(part.column("label").is_null())
            if mine.num_rows:
                held.append(mine)
                texts += mine.column("text").to_pylist()
                places_of += [[] for _ in range(mine.num_rows)]
            for label in part.column("label").drop_null().to_pylist():
                labels.append(label)
                size += len(label)
                if size > SHARD_CHARS:
                    _read(labels, texts, places_of)
                    labels, size = [], 0
    _read(labels, texts, places_of)
    yield from finished(held, texts, places_of)


def _by_words(out: DataFrame, keys: DataFrame, chars: int, scratch: Scratch) -> DataFrame:
    """Adds to (row, text, found) the places of ``keys`` (key, word), where ``word`` is one of the label's."""
    blocks = -(-chars // BLOCK_CHARS)
    texts = out.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, blocks))))
    texts = scratch.save(texts, "blocks")
    words = texts.select("block", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)))).alias("word")).distinct()
    asked = words.join(keys, "word").select("block", F.col("key").alias("label"))
    null = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns]
    rows = texts.select("block", F.lit(None).cast("string").alias("label"), *out.columns).unionByName(asked.select("block", "label", *null))
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("label").isNotNull())
    return dealt.mapInArrow(_read_blocks, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))


def shards(labels: DataFrame, label_col: str = "label", least: int = 2, size: int = SHARD_CHARS) -> Iterator[tuple[str, ...]]:
    """The distinct normalised labels of ``least`` characters or more, a shard at a time, those of one head together where they fit."""
    scratch = Scratch(labels.sparkSession, "labels")
    keys = scratch.save(labels.select(normalize(F.col(label_col)).alias("key")).where(F.length("key") >= max(1, least)).distinct(), "keys")
    total = keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    count = max(1, -(-total // size))
    # a head that fills shards of its own is dealt by the whole label
    heads = keys.groupBy(F.substring("key", 1, HEAD).alias("head")).agg(F.sum(F.length("key")).alias("n"))
    big = heads.where(F.col("n") > size // 4).select("head")
    by_head = keys.join(F.broadcast(big.limit(4 * count + 1)), F.substring("key", 1, HEAD) == F.col("head"), "left")  # there are no more such heads
    dealt = scratch.save(by_head.select("key", F.pmod(F.xxhash64(F.when(F.col("head").isNull(), F.substring("key", 1, HEAD)).otherwise(F.col("key"))), F.lit(count)).alias("shard")), "shards")
    for k in range(count):
        yield tuple(sorted(r.key for r in dealt.where(F.col("shard") == k).select("key").collect()))  # one shard


def find_labels(texts: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "label", bounded: bool = True, least: int = 2, name: str = "found") -> DataFrame:
    """``texts`` with an array ``name`` of struct(label, start, end): each place where the normalised text holds a label.

    Places count from 0 in the normalised text, in order of start, longer ones first; overlapping ones are all there
    (``leftmost`` chooses among them). ``bounded`` asks for word boundaries at ASCII letters and digits. Labels are compared
    after normalisation and count once; blank ones, and those shorter than ``least``, find nothing. A null text is
    empty. An array is bounded by its own text.
    """
    spark = texts.sparkSession
    ship_package(spark)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(texts.columns)]).alias("row")
    out = texts.select(row, normalize(F.col(text_col)).alias("text"), F.array().cast(_PLACES).alias("found"))
    schema, scratch, one = out.schema, Scratch(spark, "scan"), True
    labels, keys = labels.select(F.col(label_col).alias("label")).distinct(), None
    if bounded:
        runs = F.regexp_extract_all("key", F.lit("[a-z0-9]+"), F.lit(0))
        longest = F.array_max(F.transform(runs, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
        every = scratch.save(labels.select(normalize(F.col("label")).alias("key")).where(F.length("key") >= max(1, least)).distinct().withColumn("word", longest), "keys")
        keys, labels = every.where("word IS NOT NULL"), every.where("word IS NULL").select(F.col("key").alias("label"))
    for shard in shards(labels, "label", least) if keys is None or not labels.isEmpty() else ():
        out = out if one else scratch.save(out, "shard")  # so the driver holds one shard at a time
        out, one = out.mapInArrow(_scan(shard, bounded), schema), False
    columns = lambda: [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(texts.columns)]
    if keys is not None:
        chars = texts.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
        return _by_words(out, keys, chars, scratch).select(*columns(), F.col("found").alias(name))
    key = lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x.alias("x"))
    ordered = F.transform(F.array_sort(F.transform("found", key)), lambda x: x["x"])
    return out.select(*columns(), ordered.alias(name))


def leftmost(found) -> "F.Column":
    """Of an array of places in order, those of a reading from left to right: the leftmost, of those the longest, and on from its end."""
    state = "struct<free:int,kept:array<struct<label:string,start:int,end:int>>>"
    none = F.struct(F.lit(0).alias("free"), F.array().cast(_PLACES).alias("kept")).cast(state)
    step = lambda held, x: F.when(x["start"] >= held["free"], F.struct(x["end"].alias("free"), F.concat(held["kept"], F.array(x)).alias("kept")).cast(state)).otherwise(held)
    return F.aggregate(found, none, step, lambda held: held["kept"])


def find_entities(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 10) -> DataFrame:
    """(id, entity, label, rank): the entities that a text names anywhere, the longest names first, ``limit`` of each text.

    ``names`` has (entity, label), the aliases of an entity among its labels; an entity counts with the longest of its labels
    that the text holds, and ties go to the lesser name. A label that several entities share names each of them.
    """
    found = find_labels(texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), names, bounded=False)
    held = found.select("doc_id", F.explode(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("key"))
    index = names.select("entity", normalize(F.col("label")).alias("key")).distinct()
    best = held.join(index, "key").groupBy("doc_id", "entity").agg(F.min(F.struct((-F.length("key")).alias("n"), "key")).alias("b"))
    order = Window.partitionBy("doc_id").orderBy("b.n", "entity")
    out = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select(F.col("doc_id").alias(id_col), "entity", F.col("b.key").alias("label"), "rank")
