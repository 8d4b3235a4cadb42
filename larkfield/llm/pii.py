"""Personal data by weak supervision.

Fixed patterns give the base spans. Beyond them, candidate spans are voted on by regex, gazetteer and
context labelers; expectation-maximisation over the counts of all vote patterns estimates how reliable
each labeler is. The model is identified: a labeler's votes are right with one probability, which begins
at what the labeler is meant to be and stays above chance, an abstention says nothing, and base spans that
the labelers see beside the candidates count as personal. So a candidate that nothing speaks for is
never taken, in small tables and in large ones. The soft labels train a logistic span classifier in numpy, which
begins as the labelers' own weights and learns from shapes and neighbours what these leave open. Candidates
that the classifier accepts are added; base spans always stay. The corpus is scanned twice, without a shuffle
of texts: what the driver gets is one count for each vote pattern (2 * 3 ** labelers at most) and about
``TRAIN_SPANS`` distinct candidates with their counts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkfield.llm import kernels
from larkfield.runtime import Scratch, read_table, ship_package

KINDS = ("email", "ip", "card", "phone", "contact", "number", "person")
TRAIN_SPANS = 20_000
FEATURES = 1 << 12
ACCEPT = 0.9
SCAN_BYTES = 4 << 20

# The base patterns, with possessive repeats and anchors that change no match but keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_CANDIDATE = re.compile(
    r"(?P<contact>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,12})"
    r"|(?P<number>(?<![0-9A-Za-z.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,40}(?![0-9A-Za-z]))"
    r"|(?P<person>\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?)"
    r"|(?<=[Nn]ame:\x20)(?P<named>[A-Z][a-z]{1,30}\x20[A-Z][a-z]{1,30})"
)
_MAYBE = re.compile(r"[0-9]{2}|\bM(?:r|rs|s|me)\b|\bDr\b|\bProf\b|\bHerr\b|\bFrau\b|\bSra?\b|[\[(]at[\])]|[Nn]ame:")
_NEAR = re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|tél|teléfono|contact|mail|email|e-mail|card|visa|iban|account|konto|ssn|passport|name)\b", re.I)
_NOT_NEAR = re.compile(r"(?:\b(?:version|license|licence|isbn|issn|page|chapter|section|figure|table|year|copyright|total|sum|price|step|line)\b|[$€£#=\"'])\W*$", re.I)
#: gazetteers where no others are given: given names, and leading digits of card numbers
NAMES = frozenset("anna ben carlos claire david elena emma felix hans ines jan jean john jose juan julia klaus laura louis lucia maria marie mark martin mary michael paul peter pierre robert sarah sofia thomas".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
#: names that a gazetteer may hold, as it travels to every task
MOST_NAMES = 500_000
#: labelers, with how often they are meant to be right
LABELERS = {
    "address shape": 0.98, "phone shape": 0.9, "check digit": 0.97, "plain number": 0.85, "names": 0.92, "title or field": 0.88,
    "issuers": 0.7, "near cue": 0.9, "other cue": 0.9,
}
#: votes that a labeler's meant reliability counts for, and candidates that the meant share counts for
WEIGHT, SHARE, SHARE_WEIGHT = 20.0, 0.3, 20.0
#: bounds of a labeler's reliability, and of the share of candidates that are personal (narrow, so that many decoys don't outvote labelers)
RIGHT, PERSONAL = (0.55, 0.99), (0.2, 0.4)


def load_names(spark: SparkSession, path: str) -> frozenset:
    """A gazetteer of given names from text files, a name a line; MOST_NAMES at most, else ValueError."""
    names = spark.read.text(path).select(F.lower(F.trim("value")).alias("n")).where("n != ''").distinct().limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names")
    return frozenset(r.n for r in names)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, sorted."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(start, kind, end) of spans that the base patterns left alone."""
    if not _MAYBE.search(text):
        return
    taken = sorted((s, e) for s, _, e in base)
    k = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        yield start, KINDS.index("person" if m.lastgroup == "named" else m.lastgroup), end


def votes(text: str, start: int, kind: int, end: int, names: frozenset = NAMES) -> int:
    """The labelers' votes as digits to base 3: 0 abstains, 1 says personal, 2 says not."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before, name = text[max(0, start - 40) : start], KINDS[kind]
    number = name in ("number", "card", "phone")
    out = [
        1 if name in ("contact", "email") else 0,
        1 if number and re.fullmatch(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", span) else 0,
        (1 if luhn(digits) else 2) if number and not span.startswith("+") and 12 <= len(digits) <= 19 else 0,
        2 if number and (len(digits) < 9 or len(set(digits)) < 3) else 0,
        1 if name == "person" and any(w.lower() in names for w in re.findall(r"[^\W\d_]+", span)) else 0,
        1 if name == "person" else 0,
        (1 if digits.startswith(ISSUERS) else 2) if number and len(digits) in (13, 15, 16) else 0,
        1 if name != "person" and _NEAR.search(before) else 0,
        2 if _NOT_NEAR.search(before) else 0,
    ]
    code = 0
    for v in out:
        code = 3 * code + v
    return code


def cast(code: int) -> list[int]:
    """The digits of ``votes``, one for each labeler."""
    return [code // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))]


def features(text: str, start: int, kind: int, end: int) -> list[int]:
    """Hashed features of a span: kind, shape, length, digits and the words beside it."""
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", span)))[:24]
    n = sum(c in "0123456789" for c in span)
    left = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])[-1:]
    right = re.findall(r"[^\W\d_]+", text[end : end + 24])[:1]
    names = [f"kind{kind}", f"shape{shape}", f"digits{n}", f"first{span[:1] if n else ''}", *(f"l{w.lower()}" for w in left), *(f"r{w.lower()}" for w in right)]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in names})


def reliabilities(counts: dict[tuple[int, bool], int], rounds: int = 50):
    """EM over counts of (vote pattern, whether it is a base span's): (share, reliability of each labeler, posterior of each pattern).

    The share is that of the candidates; base spans are personal for sure.
    """
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    sure = np.array([base for _, base in keys])
    v = np.array([cast(c) for c, _ in keys])
    sign = np.where(v == 1, 1.0, np.where(v == 2, -1.0, 0.0))
    meant = np.array(list(LABELERS.values()))
    met = weight * (sure | ((v > 0).sum(1) > 1))  # a vote alone says nothing about how often it is right
    share, right = SHARE, meant
    for _ in range(rounds):
        score = np.log(share / (1 - share)) + sign @ np.log(right / (1 - right))
        post = np.where(sure, 1.0, 1 / (1 + np.exp(-score)))
        open_ = weight * ~sure
        share = float(np.clip((open_ @ post + SHARE * SHARE_WEIGHT) / (open_.sum() + SHARE_WEIGHT), *PERSONAL))
        good = met @ np.where(v == 1, post[:, None], np.where(v == 2, 1 - post[:, None], 0.0))
        right = np.clip((good + meant * WEIGHT) / (met @ (v > 0) + WEIGHT), *RIGHT)
    score = np.log(share / (1 - share)) + sign @ np.log(right / (1 - right))
    return share, dict(zip(LABELERS, right.tolist(), strict=True)), dict(zip([c for c, base in keys if not base], (1 / (1 + np.exp(-score)))[~sure].tolist(), strict=True))


def _slots(feats: list[int], code: int) -> list[int]:
    """Places of a span's weights: its features, a place for each vote, and the bias."""
    return [*feats, *(FEATURES + 2 * k + v - 1 for k, v in enumerate(cast(code)) if v), FEATURES + 2 * len(LABELERS)]


def fit_spans(rows: list[tuple[list[int], int, float, float]], share: float, right: dict[str, float], rounds: int = 200) -> np.ndarray:
    """Logistic regression on (features, votes, soft label, weight), from the labelers' weights on and drawn to these."""
    start = np.zeros(FEATURES + 2 * len(LABELERS) + 1)
    for k, r in enumerate(right.values()):
        start[FEATURES + 2 * k : FEATURES + 2 * k + 2] = np.log(r / (1 - r)) * np.array([1, -1])
    start[-1] = np.log(share / (1 - share))
    w, step = start.copy(), np.zeros_like(start)
    slots = [_slots(f, code) for f, code, _, _ in rows]
    flat, row = np.concatenate(slots).astype(np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in slots])
    y, part = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    part /= part.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(rows)), -30, 30)))
        grad = np.bincount(flat, ((p - y) * part)[row], len(w)) + 1e-3 * (w - start)
        step = 0.9 * step - 0.2 * grad
        w += step
    return w


class SpanModel:
    """The classifier's weights, with the gazetteer that the votes need, and the labelers' reliabilities as a report."""

    def __init__(self, weights: np.ndarray, share: float, right: dict[str, float], names: frozenset = NAMES):
        self.weights, self.share, self.right, self.names = weights, share, right, names

    def probability(self, text: str, start: int, kind: int, end: int) -> float:
        x = self.weights[_slots(features(text, start, kind, end), votes(text, start, kind, end, self.names))].sum()
        return float(1 / (1 + np.exp(-x)))


def _texts(batches, text_at: int):
    for batch in batches:
        for part in kernels.slices(batch, batch.schema.names[text_at], SCAN_BYTES):
            yield part, part.column(text_at).to_pylist()


def _gather(names: frozenset):
    def run(batches):
        for part, texts in _texts(batches, 0):
            code, base, feats = [], [], []
            for text in texts:
                if text:
                    sure = base_spans(text)
                    for s, kind, e in candidates(text, sure):
                        code.append(votes(text, s, kind, e, names))
                        base.append(False)
                        feats.append(features(text, s, kind, e))
                    for s, kind, e in sure:
                        code.append(votes(text, s, kind, e, names))
                        base.append(True)
                        feats.append([])
            yield pa.RecordBatch.from_arrays(
                [pa.array(code, pa.int32()), pa.array(base, pa.bool_()), pa.array(feats, pa.list_(pa.int32()))], names=["votes", "base", "features"]
            )

    return run


def train(docs: DataFrame, text_col: str = "text", names: frozenset = NAMES) -> SpanModel | None:
    """The span classifier; None where the corpus has no candidates. names: a gazetteer of given names, in lower case."""
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pii")
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(kernels.tidied(_gather(names)), "votes int, base boolean, features array<int>")
    found = scratch.save(found.groupBy("votes", "base", "features").agg(F.count("*").alias("n")), "spans")
    rows = found.groupBy("votes", "base").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # 2 * 3 ** labelers rows at most
    if all(r.base for r in rows):
        scratch.close()
        return None
    share, right, post = reliabilities({(r.votes, r.base): r.n for r in rows})
    part = min(1.0, TRAIN_SPANS / sum(r.kinds for r in rows if not r.base))  # of the distinct candidates, chosen by hash
    sample = found.where(~F.col("base") & (F.pmod(F.xxhash64("features", "votes"), F.lit(1 << 30)) < int((1 << 30) * part))).collect()
    scratch.close()
    weights = fit_spans(sorted((list(r.features), r.votes, post[r.votes], r.n) for r in sample) or [([], 0, share, 1.0)], share, right)
    return SpanModel(weights, share, right, names)


def _apply(model: SpanModel | None, text_at: int, width: int):
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for part, texts in _texts(batches, text_at):
            spans, cleaned = [], []
            for text in texts:
                found = base_spans(text) if text else []
                if model is not None and text:
                    found += [(s, kind, e) for s, kind, e in candidates(text, list(found)) if model.probability(text, s, kind, e) >= ACCEPT]
                    found.sort()
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                cleaned.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:width], pa.array(spans, kind_of), pa.array(cleaned, pa.string())], names=part.schema.names
            )

    return run


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span replaced by its kind; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: SpanModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``pii`` (``pii_1``, ... if docs has that name): spans of (start, kind, end), and redacted.

    kind is a place in ``KINDS``; starts count code points, ends are exclusive, order is by start and then
    by kind. A null text has no spans and stays null when redacted. Rows are never dropped; repeated rows
    get equal answers; texts of any length are read whole.
    """
    ship_package(docs.sparkSession)
    k, name = 0, "pii"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"pii_{k + 1}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    out = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = out.select("*", none.alias("lf_spans"), F.lit(None).cast("string").alias("lf_clean"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    out = out.mapInArrow(kernels.tidied(_apply(model, names.index(text), len(names))), schema)
    answer = F.struct(F.col("lf_spans").alias("spans"), F.col("lf_clean").alias("redacted"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], answer.alias(name))


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("pii.spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return find_pii(docs, train(docs)).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_joined(F.filter(s, lambda x: x["kind"] < 4)), 256).alias("base_sha256"), _joined(s).alias("spans"),
        F.size(s).cast("long").alias("n_spans"),
    )
