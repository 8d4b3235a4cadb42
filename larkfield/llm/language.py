"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads a whole text forwards and
backwards, blanks and all, and labels every byte position; a document's probabilities are the mean over
all its positions. So that long texts run side by side, a text is read in windows: each labels ``STEP``
positions of its own, and its states have read ``CONTEXT`` bytes before these (from either side) when they
begin. Windows of many texts advance together, one byte at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from larkfield.llm import kernels
from larkfield.runtime import read_table, ship_package

HIDDEN = 8
STEP, CONTEXT = 480, 32
#: labelled documents of each language that the network is fitted on at most, and bytes of these
TRAIN_DOCS, TRAIN_BYTES = 200, 4 << 20
#: characters of a text that the network may be fitted on; no more than four bytes each
TRAIN_PIECE = TRAIN_BYTES // TRAIN_DOCS // 4
#: steps, windows of each language in a step, their bytes
STEPS, EACH, TRAIN_STEP, RATE = 300, 16, 96, 0.02
#: of the way from chance to what the least certain texts of the sample get, where a text counts as no language's
LEAST_SHARE = 0.25
_TABLE = kernels.byte_table([9, 10, 11, 12, 13, 32])


def windows(offsets: np.ndarray, step: int = STEP):
    """(first byte, bytes, bytes before its own, own bytes, text) of each window; a text without bytes has none."""
    n = np.diff(offsets)
    k = -(-n // step)
    text = np.repeat(np.arange(len(n)), k)
    own = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)) * step
    end = np.minimum(own + step, offsets[1:][text])
    lo, hi = np.maximum(own - CONTEXT, offsets[:-1][text]), np.minimum(end + CONTEXT, offsets[1:][text])
    return lo, hi - lo, own - lo, end - own, text


class Network:
    """Weights by name: for each direction an input column per byte and recurrent weights, by gate (update, reset, new); then the label layer.

    Arrays run [step, unit, row], so that every operation works on long contiguous runs. Rows are ordered by
    length, longest first: at step t only the first ``live[t]`` rows go on.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        #: a best probability below this is no language's
        self.least = 0.0
        h, c = HIDDEN, len(languages)
        self.w = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.w[d + "u"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (c, 2 * h)).astype(np.float32)
        self.w["c"] = np.zeros((c, 1), np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, logits: np.ndarray, keep: list | None = None) -> None:
        """Adds a direction's part to logits [steps, languages, rows]; keep gets what going back needs."""
        h, wx, u = HIDDEN, self.w[d + "x"], self.w[d + "u"]
        o = self.w["o"][:, :h] if d == "f" else self.w["o"][:, h:]
        state = np.zeros((h, x.shape[1]), wx.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            k = live[t]
            s = state[:, :k]
            a, q = wx[:, x[t, :k]], u @ s
            g = a[: 2 * h] + q[: 2 * h]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:h], g[h:]
            n = r * q[2 * h :]
            n += a[2 * h :]
            np.tanh(n, out=n)
            new = n - s
            new *= z
            new += s
            if keep is not None:
                keep.append((t, s.copy(), z, r, q[2 * h :], n, new))
            state[:, :k] = new
            logits[t, :, :k] += o @ new

    def _back(self, d: str, x: np.ndarray, live: np.ndarray, keep: list, grad: np.ndarray, into: dict) -> None:
        h, u = HIDDEN, self.w[d + "u"]
        o = self.w["o"][:, :h] if d == "f" else self.w["o"][:, h:]
        gx, gu, go = np.zeros_like(self.w[d + "x"]), np.zeros_like(u), np.zeros_like(o)
        carry = np.zeros((h, x.shape[1]), u.dtype)
        for t, s, z, r, qn, n, new in reversed(keep):
            k = live[t]
            go += grad[t, :, :k] @ new.T
            g = o.T @ grad[t, :, :k] + carry[:, :k]
            gn = g * z * (1 - n * n)
            pre = np.concatenate([g * (n - s) * z * (1 - z), gn * qn * r * (1 - r), gn])
            rec = np.concatenate([pre[: 2 * h], gn * r])
            carry[:, :k] = g * (1 - z) + u.T @ rec
            gu += rec @ s.T
            eye = np.zeros((256, k), u.dtype)
            eye[x[t, :k], np.arange(k)] = 1
            gx += pre @ eye.T
        into[d + "x"], into[d + "u"] = gx, gu
        into["o"][:, :h] += go if d == "f" else 0
        into["o"][:, h:] += go if d == "b" else 0

    def _both(self, x: np.ndarray, live: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        """Probabilities at every position: [steps, languages, rows]."""
        p = np.empty((x.shape[0], len(self.languages), x.shape[1]), self.w["c"].dtype)
        p[:] = self.w["c"]
        for k, d in enumerate("fb"):
            self._run(d, x, live, p, None if keep is None else keep[k])
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict:
        """Of the mean loss over all positions; x is [steps, rows], rows ordered by length n, longest first."""
        live = _live(n, len(x))
        keep: tuple = ([], [])
        g = self._both(x, live, keep)
        g[:, label, np.arange(len(n))] -= 1
        g *= (np.arange(len(x))[:, None] < n)[:, None, :] / n.sum().astype(g.dtype)
        out = {"o": np.zeros_like(self.w["o"]), "c": g.sum((0, 2))[:, None]}
        for k, d in enumerate("fb"):
            self._back(d, x, live, keep[k], g, out)
        return out

    def fit(self, raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, seed: int = 11) -> "Network":
        """Adam; every step takes as many windows of each language, from places chosen at random in all of its texts."""
        rng = np.random.default_rng(seed)
        lo, n, *_, text = windows(offsets, TRAIN_STEP)
        of = [np.flatnonzero(label[text] == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        for step in range(1, STEPS + 1):
            rows = np.concatenate([rng.choice(i, EACH) for i in of])
            rows = rows[np.argsort(-n[rows], kind="stable")]
            g = self.gradients(_steps(raw, lo[rows], n[rows]), n[rows], label[text[rows]])
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each text [texts, languages]; zeros where a text has no bytes."""
        lo, n, before, own, text = windows(offsets)
        sums = np.zeros((len(lo), len(self.languages)))
        order = np.argsort(-n, kind="stable")
        i = 0
        while i < len(order):
            rows = order[i : i + min(8192, max(64, (1 << 20) // int(n[order[i]])))]
            i += len(rows)
            x = _steps(raw, lo[rows], n[rows])
            p = self._both(x, _live(n[rows], len(x)))
            at = np.arange(len(x))[:, None]
            p *= ((at >= before[rows]) & (at < before[rows] + own[rows]))[:, None, :]
            sums[rows] = p.sum(0, dtype=np.float64).T
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            out[some] = np.add.reduceat(sums, np.searchsorted(text, some)) / np.diff(offsets)[some, None]
        return out


def _steps(raw: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of the windows [steps, rows], in lower case and with every blank alike; what follows a window's end is not read."""
    at = lo + np.arange(int(n.max()))[:, None]
    return _TABLE[raw[np.minimum(at, len(raw) - 1)]].astype(np.intp)


def _live(n: np.ndarray, steps: int) -> np.ndarray:
    """How many of the rows, longest first, are longer than t."""
    return len(n) - np.searchsorted(n[::-1], np.arange(steps), side="right")


def _sample(rows: DataFrame) -> list:
    """(lang, text) of at most TRAIN_DOCS distinct texts of each language, of the least hashes; of a long one a piece.

    A text gives TRAIN_PIECE characters from a place that its hash says, or all it has: so a language's texts together stay
    below TRAIN_BYTES, and no text, however long, leaves others out. Twice as many as that are let through by their
    hash before a row moves, so no task gets all rows of a language.
    """
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    place = F.shiftrightunsigned("h", 1).cast("double") / float(1 << 63)
    length = F.length("text")
    start = F.pmod("h", F.greatest(length - TRAIN_PIECE, F.lit(0)) + 1).cast("int") + 1
    some = rows.join(F.broadcast(sizes), "lang").where(place <= 2.0 * TRAIN_DOCS / F.col("n")).withColumn("place", place)  # bounded: a row a language
    some = some.select("lang", "h", "place", F.col("text").substr(start, F.lit(TRAIN_PIECE)).alias("text")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("place", "h")
    got = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TRAIN_DOCS).select("lang", "text").collect()
    return sorted((r.lang, r.text) for r in got)


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, may_learn) -> Network | None:
    """Fits on a bounded sample of the labelled rows (see ``TRAIN_DOCS``, ``TRAIN_PIECE``); None where there is none."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(F.col(text_col).cast("string")) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h")
    )
    got = _sample(rows)
    if not got:
        return None
    languages = sorted({lang for lang, _ in got})
    label = np.searchsorted(languages, [lang for lang, _ in got])
    raw, offsets = kernels.string_views(pa.array([t for _, t in got], pa.large_string()))
    net = Network(languages).fit(raw, offsets, label)
    best = net.pooled(raw, offsets).max(1)
    chance = 1 / len(languages)
    net.least = chance + LEAST_SHARE * max(0.0, float(np.quantile(best, 0.01)) - chance) - 1e-6
    return net


def _predict(net: Network, text_at: int, width: int):
    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, batch.schema.names[text_at], 1 << 20):
                raw, offsets = kernels.string_views(part.column(text_at))
                p = net.pooled(raw, offsets)
                some = np.diff(offsets) > 0
                lang = [net.languages[k] if s else None for k, s in zip(p.argmax(1).tolist(), some.tolist(), strict=True)]
                score = np.where(some, np.round(np.clip(p.max(1), 0, 1), 6), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=batch.schema.names
                )

    return run


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language`` (lang, score) at the end (``language_1``, ... if docs has that name).

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.
    Every byte of every text is labelled; texts of any length are fine; scores are rounded to six places,
    so that equal texts get equal answers beside other texts too.
    """
    ship_package(docs.sparkSession)
    k, name = 0, "language"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"language_{k + 1}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    out = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    out = out.select("*", F.lit(None).cast("string").alias("lf_lang"), F.lit(0.0).alias("lf_score"))
    if net is not None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
        out = out.mapInArrow(kernels.tidied(_predict(net, names.index(text), len(names))), schema)
    known = F.col(text).rlike(r"\p{L}") & F.col("lf_lang").isNotNull()
    answer = F.struct(
        F.when(known, F.col("lf_lang")).otherwise("und").alias("lang"), F.when(known, F.col("lf_score")).otherwise(0.0).alias("score")
    )
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], answer.alias(name))


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1 (or the id is null)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs, "doc_id", "text", "lang", ~held_out())
    return identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
