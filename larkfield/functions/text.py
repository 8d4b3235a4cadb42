"""Text functions: normalisation, tokens, query terms, chunks, snippets, labels and identifiers.

Column functions stay in the JVM, NFKC included (``nfkc``). Only sentence packing needs Python, and then runs as an Arrow UDF.
Tasks that take texts in Arrow batches cut the ``plain`` ones into tokens in bulk (``plain_words``).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from larkfield.functions.nfkc import nfkc
from larkfield.runtime import ship_active

# The word lists that decide which tokens count.
STOP_WORDS = (
    "a an the of in on for to and or is are was were be been being with by from as at it its this that these those "
    "there their they we you i not no if then than which who whom what when where how can may might must should would "
    "could will shall do does did done have has had me my mine our ours us your yours him her them"
).split()
QUERY_FILLER_EN = (
    "please help tell explain knowledge information advice method methods management treatment control query reference "
    "disease diseases plant plants crop crops agriculture agricultural symptoms"
).split()
QUERY_FILLER_ZH = (
    "请问 请帮我 帮我 告诉我 知识库 农业知识 相关知识 相关资料 相关信息 有没有 有什么 是什么 怎么 如何 什么 哪些 一下 一下子 "
    "有关 相关 知识 资料 信息 方法 建议 管理 防治 治疗 处理 处置 查询 参考 病害 农业 作物 植物 常识 症状 的 了 吗 呢"
).split()
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"


def normalize(text: Column) -> Column:
    """NFKC, lower case, runs of white space as one space, stripped; null is empty."""
    return F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"(?U)\s+", " "))


def normalize_text(text: str | None) -> str:
    """NFKC, lower case, white space folded: the rule that ``normalize`` follows, for one string."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip()


def tokenize(text: Column, normal: bool = False) -> Column:
    """Tokens of a text: characters and neighbouring pairs of each CJK run, then ASCII words that are no stop words.

    NFKC and lower case are all that tokens need of ``normalize``, as white space only separates them.
    """
    text = text if normal else F.lower(nfkc(F.coalesce(text, F.lit(""))))
    return F.element_at(F.transform(F.array(text), _tokens), 1)  # so that the text is normalised once


def _tokens(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(run))
        one = F.transform(at, lambda i: run.substr(i, F.lit(1)))
        two = F.filter(F.transform(at, lambda i: run.substr(i, F.lit(2))), lambda g: F.length(g) == 2)
        return F.concat(one, two)

    cjk = F.when(F.rlike(text, F.lit(f"[{CJK}]")), F.flatten(F.transform(runs, grams))).otherwise(F.array().cast("array<string>"))
    return F.concat(cjk, words)


# Fixed value: what NFKC could make part of a token, or join with its neighbours. All else is ASCII, letters and signs of western
# scripts, dashes and quotes, which only separate. Java tries each range of a class for each character, so there are few.
_OTHER = r"[\xa0\xa8\xaa\xaf\xb2\xb3\xb4\xb5\xb8\xb9\xba\xbc\xbd\xbe\x{130}-\x{2011}\x{2017}\x{2024}-\x{10ffff}]"


def plain(text: Column) -> Column:
    """Whether the tokens of a text are its ASCII words in lower case, with nothing that NFKC could change."""
    return ~F.rlike(text, F.lit(_OTHER))


#: of each byte the lower case if it is an ASCII letter or digit, else 0
_WORD_BYTES = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def plain_words(texts: pa.Array) -> pa.ListArray:
    """The tokens that ``tokenize`` gives for texts that are ``plain``; null has none."""
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    large = lambda v: pa.scalar(v, pa.large_string())
    spaced = pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), large(""), large(" "))  # no word goes on in the next text
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1]
    letters = _WORD_BYTES[np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]]]
    inside = letters != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    begin, end = edges[::2], edges[1::2]
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, np.cumsum(end - begin)).astype(np.int32)), pa.py_buffer(letters[inside]))
    keep = ~pc.is_in(words, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(keep))
    return pa.ListArray.from_arrays(pa.array(before[np.searchsorted(begin, ends)], pa.int32()), words.filter(pa.array(keep)))


def query_terms(text: Column) -> Column:
    """Distinct tokens that may serve as evidence: fillers become spaces, two characters at least."""
    clean = F.regexp_replace(normalize(text), "|".join(QUERY_FILLER_ZH), " ")
    return F.filter(F.array_distinct(tokenize(clean)), lambda w: (F.length(w) >= 2) & ~w.isin(QUERY_FILLER_EN))


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit("[一-鿿]"))


# Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[。！？；!?;])|(?<=\.\s)|\n+"


def sentences(text: str) -> list[str]:
    """Split after terminators (those of CJK text, ``! ? ;``, a full stop and white space) and at line ends."""
    pieces = re.split(SENTENCE_END, text or "")
    return [p for p in map(str.strip, pieces) if p]


def _packed(pieces: list[str], max_chars: int, overlap: int):
    held = ""
    for piece in pieces:
        long = len(piece) > max_chars
        if held and (long or len(held) + len(piece) > max_chars):
            yield held
            held = "" if long else held[max(len(held) - overlap, 0) :]
        if long:
            yield from (piece[at : at + max_chars] for at in range(0, len(piece), max_chars - overlap))
        else:
            held += piece
    yield held


def chunks(text: str | None, max_chars: int = 520, overlap: int = 80) -> list[str]:
    """Sentences packed into chunks of at most ``max_chars``; a new chunk begins with the end of the last.

    A sentence that is too long by itself is cut every ``max_chars - overlap`` characters.
    """
    text = (text or "").strip()
    if len(text) <= max_chars:
        return [text] if text else []
    return [c.strip() for c in _packed(sentences(text), max_chars, overlap) if c.strip()]


def chunk_udf(max_chars: int = 520, overlap: int = 80):
    ship_active()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunks(t, max_chars, overlap))

    return run


def snippet(text: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters, with an ellipsis where it was cut."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def clip(text: Column, limit: int) -> Column:
    """Like ``snippet`` but with line ends kept."""
    line = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def label_pattern(label: str, underscore: bool = False) -> str:
    """A regex for a label; ends that are ASCII letters or digits ask for a word boundary there."""
    inner = "a-z0-9_" if underscore else "a-z0-9"
    out = re.escape(label)
    if label[:1].isascii() and label[:1].isalnum():
        out = f"(?<![{inner}])" + out
    if label[-1:].isascii() and label[-1:].isalnum():
        out += f"(?![{inner}])"
    return out


def has_label(text: Column, label: str, underscore: bool = True) -> Column:
    """Whether a normalised text names a label."""
    return F.rlike(text, F.lit(label_pattern(normalize_text(label), underscore))) if label else F.lit(False)


def alias_list(text: Column) -> Column:
    """Aliases separated by any of six separators, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, "[;；,，、/|]"), lambda x: F.trim(x)), lambda x: x != "")


def text_of(value: Column) -> Column:
    """Null as empty, stripped."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and sixteen hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16))


def safe_component(text: Column) -> Column:
    """A string that is safe as one part of a path, 64 characters at most."""
    out = F.regexp_replace(F.replace(text, F.lit(".."), F.lit("_")), r"[^A-Za-z0-9._\-\x{4e00}-\x{9fff}]", "_")
    return F.substring(F.regexp_replace(out, r"^[._]+|[._]+$", ""), 1, 64)


def thread_id(site: Column, day: Column, *rest: Column) -> Column:
    """Sixteen hex digits of SHA-256 over the upper-cased site, the date and further parts."""
    return F.substring(F.sha2(F.concat_ws(":", F.upper(site), day, *rest), 256), 1, 16)
