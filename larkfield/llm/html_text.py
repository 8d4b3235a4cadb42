"""Main text of web pages: markup names what is no article, suffix arrays over a host's pages find the boilerplate it doesn't name.

Every page becomes blocks of text outside of menus, headers, footers and the like (``blocks_of``). The blocks of a host's
pages are token streams, laid end to end in shards of bounded size. The suffix array of a shard, sorted by ``RUN``
tokens, shows which runs several distinct pages share. A run that half of a host's pages hold is held by half of the pages
of some shard, so what any shard finds frequent is counted in all shards of its host, exactly. Blocks that frequent
runs cover are removed; the unique runs stay.

An article that is marked as such loses a block only to runs that nearly all pages of its host hold, and nothing if
these would cover most of it: then it is a copy, and copies are articles too.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkfield.llm import kernels
from larkfield.llm.url_filter import host_of
from larkfield.runtime import Scratch, read_table, ship_package

#: tokens of a run, a power of two; block edges are tokens
RUN = 8
#: a run is boilerplate in (share of a host's distinct pages, pages at least): of pages without, and with a marked article
OPEN, MARKED = (0.5, 3), (0.8, 5)
#: a block goes if no more than this share of its words is outside frequent runs
UNIQUE = 0.2
SHARD_BYTES = 1 << 20
EDGE = "\x1e"

# Elements, roles and words in class and id that name what is no main text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
NO_TEXT = set("aside audio button canvas dialog footer form head iframe input map menu nav object select svg template video".split())
NO_TEXT_ROLES = set("alert alertdialog complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_TEXT_WORDS = set(
    "ad ads adsbygoogle adv advert advertisement advertisements adverts alert alerts aside banner breadcrumb breadcrumbs consent "
    "cookie cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination paywall popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription trending widget widgets".split()
)
HEADER_WORDS = set("header masthead topbar".split())
COMMENT_WORDS = set("comment commentlist comments disqus replies reply respond".split())
#: elements that stand for white space
SPACE = {"br", "img", "td", "th"}
#: a new element of these ends an open one of the same
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(?i:(" + "|".join(sorted(RAW)) + r"))\b[^<>]*>.*?(?:</(?i:\1)\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)(?:\s*>|((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<>]*)>)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _noise(name: str, attributes: str, inside: bool) -> int:
    """0 for an element that may hold main text, 1 for one that its words speak against, 2 for one that has none."""
    if name in NO_TEXT or (name == "header" and not inside):
        return 2
    if not attributes or attributes.isspace():
        return 0
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return 2
    words = set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    if words & COMMENT_WORDS and name not in ("html", "body", "main"):
        return 2
    if name in ("html", "body", "main", "article"):
        return 0
    roles = set(a.get("role", "").lower().split())
    if roles & NO_TEXT_ROLES or ("banner" in roles and not inside):
        return 2
    return int(bool(words & NO_TEXT_WORDS or (words & HEADER_WORDS and not inside)))


@functools.cache
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<!--.*?(?:-->|\Z)|<(?i:(script|style)\b).*?(?:</(?i:\1)|\Z)|<(/?)(?i:{re.escape(name)})\b[^<>]*>", re.S)


def _end(page: str, name: str, at: int) -> int:
    """Where the element that was opened before ``at`` is closed, elements of the same name in it counted; -1 if it never is."""
    depth = 1
    for m in _ends(name).finditer(page, at):
        if m[2] is not None:
            depth += -1 if m[2] else 1
            if not depth:
                return m.end()
    return -1


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """(blocks of the main text in page order, whether an element marks it) of one page's html.

    White space of a block is one space, character references are decoded. The text is what lies in article elements,
    else in the main one, else in the body. Elements that are never closed end with the one around them.
    """
    blocks: list[tuple[int, str]] = []
    stack: list[list] = []  # [name, noise, level before]
    held: list[str] = []
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    noise = level = at = 0
    page = page or ""

    def flush():
        text = "".join(held)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            blocks.append((level, text))
        held.clear()

    def close(k: int):
        nonlocal noise, level
        for name, bad, was in reversed(stack[k:]):
            noise -= bool(bad)
            level = was
            opened[name] -= 1
        del stack[k:]

    for found in _TOKEN.finditer(page):
        start = found.start()
        if start < at:
            continue  # inside an element that was skipped
        if not noise and start > at:
            held.append(page[at:start])
        at = found.end()
        raw, ends, name, quoted, plain = found.groups()
        if name is None:
            if raw and held and raw.lower() in BLOCKS:
                flush()
            continue
        if name not in BLOCKS:
            name = name.lower()
        block = name in BLOCKS
        if block and held:
            flush()
        if ends:
            for k in () if not opened.get(name) else range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if not block and stack[k][0] in BLOCKS:
                    break  # an inline element doesn't end the block that it was opened around
            continue
        if block:
            for i in range(len(stack) - 1, -1, -1):  # what a new block ends: a paragraph, or an item of the same list
                if stack[i][0] in BLOCKS:
                    if stack[i][0] == "p" or name in SAME.get(stack[i][0], ()):
                        close(i)
                    break
        elif name in SPACE and not noise:
            held.append(" ")
        attributes = quoted or plain or ""
        if name in VOID or attributes.endswith("/") and not block:
            continue
        bad = _noise(name, attributes, level > 0)
        if bad == 2 and name not in unclosed:  # nothing in it counts: on to its end, if it has one
            end = _end(page, name, at)
            if end >= 0:
                at = end
                continue
            unclosed.add(name)
        if name in ("article", "main") and not bad and noise and all(s[1] < 2 for s in stack):
            for s in stack:  # words alone don't speak against an element that holds the article
                noise, s[1] = noise - bool(s[1]), 0
        stack.append([name, bad, level])
        opened[name] = opened.get(name, 0) + 1
        noise += bool(bad)
        if name == "article" or (name == "main" and level < 1):
            level = max(level, 2 if name == "article" else 1)
    if not noise:
        held.append(page[at:])
    flush()
    best = max((k for k, _ in blocks), default=0)
    return [text for k, text in blocks if k == best], best > 0


def _stream(blocks: list[str]) -> str:
    return f" {EDGE} ".join(["", *blocks, ""]).strip() if blocks else ""


_PARSED = T.StructType().add("marked", "boolean").add("stream", "binary").add("text", "string")


def _parse(distinct: bool, join: bool = False):
    """(row, host, html) becomes (row, host, marked, stream, text).

    text is the blocks between edges, or with ``join`` as they are returned; ``distinct`` leaves out streams that the task has had.
    """

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in kernels.slices(batch, "html", 4 << 20):
                marked, streams, texts, keep = [], [], [], []
                hosts = part.column("host").to_pylist() if distinct else None
                for i, page in enumerate(part.column("html").to_pylist()):
                    blocks, is_marked = blocks_of(page)
                    text = "\n\n".join(blocks) if join else _stream(blocks)
                    key = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                    if distinct:
                        own = hashlib.md5(hosts[i].encode() + key).digest()
                        if not blocks or own in seen:
                            continue
                        seen.add(own)
                    keep.append(i)
                    marked.append(is_marked)
                    streams.append(key)
                    texts.append(text.encode("utf-8", "replace"))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(at), part.column("host").take(at), pa.array(marked, pa.bool_()), pa.array(streams, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["row", "host", "marked", "stream", "text"],
                )

    return run


def _groups(batches, distinct: bool):
    """Batches in the order of host, shard and kind become (host, shard, windows, pages); ``distinct`` keeps one page of equal streams."""
    held, key, last = [], None, None
    for batch in batches:
        hosts, shards = batch.column("host").to_pylist(), batch.column("shard").to_pylist()
        cuts = [0, *(i for i in range(1, len(hosts)) if (hosts[i], shards[i]) != (hosts[i - 1], shards[i - 1])), len(hosts)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if (hosts[a], shards[a]) != key:
                if held:
                    yield *key, *_split(held)
                held, key, last = [], (hosts[a], shards[a]), None
            part = batch.slice(a, b - a)
            if distinct:
                keep = []
                for i, (kind, stream) in enumerate(zip(part.column("kind").to_pylist(), part.column("stream").to_pylist())):
                    if not kind or stream != last:
                        keep.append(i)
                    last = stream if kind else last
                part = part.take(pa.array(keep, pa.int64()))
            held.append(part)
    if held:
        yield *key, *_split(held)


def _split(held: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    table = pa.Table.from_batches(held).combine_chunks()
    kind = table.column("kind").to_numpy()
    return table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))


class _Shard:
    """The token streams of some pages of a host, end to end."""

    def __init__(self, texts: pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string())
        raw, offsets = kernels.string_views(column)
        self.h, _, _, self.first = kernels.hash_words(raw, offsets, kernels.SPACE_WORDS)
        self.page = np.repeat(np.arange(len(column)), np.diff(self.first))
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.h))
        self.starts = np.flatnonzero(left >= RUN)  # where a run of one page begins
        both = [kernels.hash_windows(self.h ^ np.uint64(salt), RUN).view(np.int64) for salt in (0, 0x5DEECE66D)]
        self.w1, self.w2 = ((w[self.starts] if len(w) else np.zeros(0, np.int64)) for w in both)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by the first RUN tokens, by doubling: (places in order, rank of each; equal ranks share a run)."""
        rank = np.unique(self.h, return_inverse=True)[1].astype(np.int64)
        step = 1
        while step < RUN:
            behind = np.zeros(len(rank), np.int64)
            behind[:-step] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + 2) + behind, return_inverse=True)[1].astype(np.int64)
            step *= 2
        rank = rank[self.starts]
        order = np.argsort(rank, kind="stable")
        return order, rank[order]

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``starts``, distinct pages) of one suffix of every run that ``least`` pages share."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, rank = self.suffixes()
        page = self.page[self.starts[order]]
        begin = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        new = np.r_[True, (rank[1:] != rank[:-1]) | (page[1:] != page[:-1])]  # places of a rank are in page order
        pages = np.add.reduceat(new.astype(np.int64), begin)
        found = pages >= least
        return order[begin[found]], pages[found]

    def held(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """For each start, the index of the given window that begins there, or -1. ``w1`` is sorted."""
        if not len(w1):
            return np.full(len(self.starts), -1)
        at = np.minimum(np.searchsorted(w1, self.w1), len(w1) - 1)
        return np.where((w1[at] == self.w1) & (w2[at] == self.w2), at, -1)


def _windows(table: pa.Table):
    w1, w2 = (table.column(c).to_numpy() for c in ("w1", "w2"))
    order = np.argsort(w1, kind="stable")
    return w1[order], w2[order], table.column("level").to_numpy()[order]


_COUNT = T.StructType().add("host", "string").add("shards", "long").add("w1", "long").add("w2", "long").add("pages", "long")


def _batch(host, shards, w1, w2, pages) -> pa.RecordBatch:
    n = len(pages)
    return pa.RecordBatch.from_arrays(
        [pa.array([host] * n, pa.string()), pa.array([shards] * n, pa.int64()), pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(pages, pa.int64())],
        names=_COUNT.names,
    )


def _candidates(batches):
    """Runs that are frequent in their shard; a row of a null run has the shard's distinct pages."""
    for host, _, _, pages in _groups(batches, True):
        shards, n = pages.column("shards")[0].as_py(), pages.num_rows
        shard = _Shard(pages.column("text"))
        yield _batch(host, shards, [None], [None], [n])
        least = max(int(np.ceil(OPEN[0] * n)), OPEN[1] if shards == 1 else 1)
        at, count = shard.frequent(least)
        if len(at):
            yield _batch(host, shards, shard.w1[at], shard.w2[at], count)


def _recount(batches):
    """The distinct pages of a shard that hold each of the given runs."""
    for host, _, windows, pages in _groups(batches, True):
        if not (windows.num_rows and pages.num_rows):
            continue
        w1, w2, _ = _windows(windows)
        shard = _Shard(pages.column("text"))
        which = shard.held(w1, w2)
        pair = np.unique(which[which >= 0] * pages.num_rows + shard.page[shard.starts[which >= 0]])
        count = np.bincount(pair // pages.num_rows, minlength=len(w1))
        yield _batch(host, 0, w1[count > 0], w2[count > 0], count[count > 0])


def _unique(batches):
    """(row, text): the blocks of each page that no frequent run covers."""
    for _, _, windows, pages in _groups(batches, False):
        if not pages.num_rows:
            continue
        w1, w2, level = _windows(windows)
        shard = _Shard(pages.column("text"))
        which, marked = shard.held(w1, w2), pages.column("marked").to_numpy()
        counts = (which >= 0) & (~marked[shard.page[shard.starts]] | (level[which] == 2)) if len(w1) else np.zeros(len(which), bool)
        cover = np.zeros(len(shard.h) + 1, np.int64)
        np.add.at(cover, shard.starts[counts], 1)
        np.add.at(cover, shard.starts[counts] + RUN, -1)
        covered = np.cumsum(cover)[:-1] > 0
        out = []
        for i, text in enumerate(pages.column("text").to_pylist()):
            blocks = [b for b in (text or "").split(f" {EDGE} ")]
            blocks = [b.removeprefix(EDGE).removesuffix(EDGE).strip() for b in blocks]
            blocks = [b for b in blocks if b]
            at, gone, words, kept = int(shard.first[i]) + 1, 0, 0, []
            for b in blocks:
                n = b.count(" ") + 1
                hit = int(covered[at : at + n].sum())
                at, words = at + n + 1, words + n
                if n - hit > UNIQUE * n:
                    kept.append(b)
                else:
                    gone += n
            out.append("\n\n".join(blocks if marked[i] and 2 * gone > words else kept))
        yield pa.RecordBatch.from_arrays([pages.column("row").combine_chunks(), pa.array(out, pa.string())], names=["row", "text"])


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` (``text_1``, ... where taken): the page's main text, its blocks joined by an empty line.

    Null html, or a page without main text, gives an empty text. Pages whose url has no host stand alone, as do hosts of
    fewer than three distinct pages. Exact copies count as one page. Texts are read whole; ties and repeated rows all
    stay; an empty table gives no rows. Runs are compared by 128-bit hashes of their tokens.
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "pages")
    others = [c for c in pages.columns if c != html_col]
    k, name = 0, "text"
    while name.lower() in {c.lower() for c in others}:
        k, name = k + 1, f"text_{k + 1}"
    host = host_of(F.col(url_col).cast("string")).alias("host") if url_col in pages.columns else F.lit("").alias("host")
    page = F.col(html_col).cast("string").alias("html")
    sizes = pages.select(host, F.octet_length(page).alias("n")).where("host <> ''").groupBy("host").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    many = F.greatest(F.lit(1), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("long")
    sizes = scratch.save(sizes.where(f"rows >= {OPEN[1]}").select("host", many.alias("shards")), "hosts")

    def parsed(rows: DataFrame, distinct: bool, join: bool = False) -> DataFrame:
        kind = T.StructType([rows.schema["row"], T.StructField("host", T.StringType()), *_PARSED.fields])
        return rows.mapInArrow(kernels.tidied(_parse(distinct, join)), kind)

    def dealt(rows: DataFrame, salt, windows: DataFrame | None):
        """Pages, and the windows of their hosts in each of these' shards, in groups of host and shard."""
        rows = rows.select("host", "shards", F.pmod(salt, F.col("shards")).alias("shard"), F.lit(1).alias("kind"), "stream", "marked", "text", "row", *[F.lit(None).cast(t).alias(c) for c, t in (("w1", "long"), ("w2", "long"), ("level", "int"))])
        if windows is not None:
            shard = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
            null = [F.lit(None).cast(t).alias(c) for c, t in (("stream", "binary"), ("marked", "boolean"), ("text", "string"), ("row", rows.schema["row"].dataType))]
            rows = rows.unionByName(windows.select("host", "shards", shard, F.lit(0).alias("kind"), *null, "w1", "w2", F.col("level").cast("int")))
        return rows.repartition("host", "shard").sortWithinPartitions("host", "shard", "kind", "stream")

    slim = pages.select(F.lit(0).alias("row"), host, page).where("host <> ''")
    by_stream = F.xxhash64("stream")
    streams = parsed(slim, True).join(sizes, "host")
    found = scratch.save(dealt(streams, by_stream, None).mapInArrow(kernels.tidied(_candidates), _COUNT), "runs")
    totals = found.where("w1 IS NULL").groupBy("host").agg(F.sum("pages").alias("n"))
    runs = found.where("w1 IS NOT NULL")
    split = runs.where("shards > 1").select("host", "shards", "w1", "w2", F.lit(0).alias("level")).distinct()
    counted = runs.where("shards = 1").select("host", "shards", "w1", "w2", "pages")
    if split.limit(1).count():
        split = scratch.save(split, "split")
        again = parsed(slim.join(split.select("host").distinct(), "host", "left_semi"), True).join(sizes, "host")
        more = dealt(again, by_stream, split).mapInArrow(kernels.tidied(_recount), _COUNT).groupBy("host", "w1", "w2").agg(F.sum("pages").alias("pages"))
        counted = counted.unionByName(more.join(sizes, "host").select("host", "shards", "w1", "w2", "pages"))
    often = lambda share, least: F.col("pages") >= F.greatest(F.lit(least), share * F.col("n"))
    level = F.when(often(*MARKED), 2).when(often(*OPEN), 1)
    bad = scratch.save(counted.join(totals, "host").withColumn("level", level).where("level IS NOT NULL").select("host", "shards", "w1", "w2", "level"), "boilerplate")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(0).alias("c"))
    full = pages.select(row.alias("row"), host, page)
    if not bad.limit(1).count():
        out = parsed(full, False, join=True).select("row", "text")
    else:
        hosts = bad.select("host", "shards").distinct()
        plain = parsed(full.join(hosts, "host", "left_anti"), False, join=True).select("row", "text")
        touched = parsed(full, False).join(hosts, "host")
        kind = T.StructType([full.schema["row"], T.StructField("text", T.StringType())])
        out = plain.unionByName(dealt(touched, F.monotonically_increasing_id(), bad).mapInArrow(kernels.tidied(_unique), kind))
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(others)], F.coalesce("text", F.lit("")).alias(name))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
