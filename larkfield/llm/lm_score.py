"""Language-model scoring by masked pseudo-likelihood.

Every token of a document is predicted from the three tokens on either side by a bidirectional window
network, trained in numpy; the score is the sum of the conditional log-probabilities. The network's symbols
are the ``LISTED`` most frequent words and, for all others, one symbol for each kind of ending. The softmax
over them has two levels (a class of about as frequent symbols, then the symbol within it), both given the
context. A word that isn't listed has its share of its symbol's probability by its own count in the corpus:
log P(word | both sides) = log P(class | both sides) + log P(symbol | class, both sides) + log n(word) / n(symbol).
So the probabilities of all words of the corpus add up to one.

Counts are over all documents. The ``COUNTED`` most frequent words are broadcast with their counts; every
other word's own count stays in a distributed table, and as log n(word) is a plain term of the sum, it is
joined to the words of each row and added to what the network gives. Training is data parallel and masked: in
each of ``ROUNDS`` rounds every task masks one in ``MASK`` tokens of all of its documents, chosen at random, and learns to
predict these; the tasks begin alike, and their weights are averaged by the tokens that each has predicted. The average is a
DataFrame aggregate, so what reaches the driver is one network, whatever the number of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkfield.llm import kernels
from larkfield.runtime import Scratch, read_table, ship_package

#: words with a symbol of their own; kinds of endings; words whose counts are broadcast
LISTED, ENDINGS, COUNTED = 8192, 24, 1 << 19
CLASSES = 64
SIDE, HIDDEN, EMBEDDING = 3, 32, 16
#: passes over all documents; one token in so many is masked in each
ROUNDS, MASK = 1, 5
BATCH, RATE = 4096, 0.1
#: outputs before a softmax are held between these, so that no exponential overflows
LOGITS = (-60, 60)
#: weights that leave a task together
CHUNK = 1 << 14
SEEN_BYTES = 4 << 20


def ending(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kind of a word by its last two bytes, in lower case."""
    low = kernels.SPACE_WORDS
    last = low[raw[end - 1]].astype(np.int64)
    before = np.where(end - begin > 1, low[raw[np.maximum(end - 2, 0)]], 0).astype(np.int64)
    return (last * 31 + before * 17) % ENDINGS


class Lookup:
    """Place of a word hash among some: a table of hashes that is addressed by their own bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        self.keys = np.append(keys, np.uint64(0))
        self.probes = 0
        todo, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(todo):  # those that find a free slot stay, the others try the next
            free = self.place[slot] < 0
            self.place[slot[free]] = todo[free]
            lost = self.place[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 where a hash is none of the keys."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.place[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.place[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != h[todo])]
        out[todo] = -1
        return out


class Vocabulary:
    """What is broadcast: the most frequent words with their counts, and the symbols in order of their classes.

    Symbols are numbered by class: those of class c are begin[c] to begin[c + 1]. The last number, ``pad``, stands for
    what lies beyond a text's ends.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, endings: np.ndarray, totals: np.ndarray):
        """Words in descending order of their counts, COUNTED at most; totals: tokens of each kind of ending."""
        listed = min(LISTED, len(words))
        self.lookup = Lookup(words)
        self.log_n = np.log(np.append(np.maximum(counts, 1), 1)).astype(np.float32)
        rest = totals - np.bincount(endings[:listed], counts[:listed], ENDINGS)
        n = np.concatenate([counts[:listed], rest]).astype(float)
        order = np.argsort(-n, kind="stable")
        root = np.sqrt(n[order])
        place = np.cumsum(root) - root  # classes take equal shares of the square roots, so frequent symbols share small ones
        of = (place * CLASSES / max(root.sum(), 1)).astype(np.int64).clip(0, CLASSES - 1)
        self.begin = np.searchsorted(of, np.arange(CLASSES + 1))
        symbol = np.empty(len(n), np.int64)
        symbol[order] = np.arange(len(n))
        self.symbol = np.append(symbol[:listed], np.zeros(len(words) - listed + 1, np.int64)).astype(np.int32)
        self.listed, self.rest, self.pad = listed, symbol[listed:].astype(np.int32), len(n)
        self.cls = np.append(of, 0).astype(np.int16)
        n = np.maximum(n[order], 0.5)
        by_class = np.bincount(of, n, CLASSES)
        #: log-probability of each class, and of each symbol in its class, by counts alone
        self.class_prior = np.log(np.maximum(by_class, 1e-9) / n.sum())
        self.prior = np.log(n / by_class[of])
        self.log_rest = np.log(np.maximum(rest, 1)).astype(np.float32)

    def encode(self, h: np.ndarray, kinds: np.ndarray):
        """(symbol, log of the word's share of it, whether its count is still to be joined) of each word."""
        at = self.lookup.find(h)
        own = (at >= 0) & (at < self.listed)
        symbols = np.where(own, self.symbol[at], self.rest[kinds])
        share = np.where(own, np.float32(0), np.where(at >= 0, self.log_n[at], np.float32(0)) - self.log_rest[kinds])
        return symbols, share, at < 0


def start(vocabulary: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by name: embeddings v, neighbours' layer m and b, classes o and c, symbols u and p. What it predicts are the counts."""
    rng = np.random.default_rng(seed)
    size = len(vocabulary.prior)
    out = {
        "v": rng.normal(0, 0.3, (size + 1, EMBEDDING)), "m": rng.normal(0, 0.3, (2 * SIDE * EMBEDDING, HIDDEN)), "b": np.zeros(HIDDEN),
        "o": np.zeros((HIDDEN, CLASSES)), "c": vocabulary.class_prior, "u": np.zeros((size, HIDDEN)), "p": vocabulary.prior,
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


def contexts(symbols: np.ndarray, first: np.ndarray, pad: int, of: np.ndarray | None = None) -> np.ndarray:
    """The 2 * SIDE neighbours of every token (or of those at ``of``); beyond a text's ends, ``pad``."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(symbols)) + SIDE * (doc + 1)
    row = np.full(len(symbols) + SIDE * len(first), pad, np.int32)
    row[place] = symbols
    place = place if of is None else place[of]
    return np.stack([row[place + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _picked(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-softmax of each row's element y; z is used up."""
    np.clip(z, *LOGITS, out=z)
    out = z[np.arange(len(y)), y]
    np.exp(z, out=z)
    return out - np.log(z.sum(1))


def _errors(z: np.ndarray, y: np.ndarray, n) -> np.ndarray:
    """Gradient by z of the sum of -log-softmax of each row's element y, over n; in place of z."""
    np.clip(z, *LOGITS, out=z)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(y)), y] -= 1
    z /= n
    return z


def _by_class(vocabulary: Vocabulary, y: np.ndarray):
    """(order of the tokens by class, classes in this order, (class, its run) of those with several symbols)."""
    order = np.argsort(vocabulary.cls[y], kind="stable")
    classes = vocabulary.cls[y[order]]
    edge = np.searchsorted(classes, np.arange(CLASSES + 1))
    several = np.flatnonzero((np.diff(edge) > 0) & (np.diff(vocabulary.begin) > 1))
    return order, classes, [(slice(vocabulary.begin[c], vocabulary.begin[c + 1]), slice(edge[c], edge[c + 1])) for c in several]


def log_probabilities(w: dict, vocabulary: Vocabulary, hidden: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P(symbol | both sides) of the symbols y, given what the hidden layer makes of both sides."""
    order, classes, runs = _by_class(vocabulary, y)
    hidden, y = hidden[order], y[order]
    logs = _picked(hidden @ w["o"] + w["c"], classes)
    for symbols, at in runs:
        logs[at] += _picked(hidden[at] @ w["u"][symbols].T + w["p"][symbols], y[at] - symbols.start)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def gradients(w: dict, vocabulary: Vocabulary, x: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean of -log P(y | x). That of v comes as (rows, their gradients)."""
    order, classes, runs = _by_class(vocabulary, y)
    x, y, n = x[order], y[order], np.float32(len(y))
    near = w["v"][x].reshape(len(y), -1)
    hidden = np.tanh(near @ w["m"] + w["b"])
    g = _errors(hidden @ w["o"] + w["c"], classes, n)
    gh = g @ w["o"].T
    gu, gp = np.zeros_like(w["u"]), np.zeros_like(w["p"])
    for symbols, at in runs:
        z = _errors(hidden[at] @ w["u"][symbols].T + w["p"][symbols], y[at] - symbols.start, n)
        gh[at] += z @ w["u"][symbols]
        gu[symbols], gp[symbols] = z.T @ hidden[at], z.sum(0)
    gh *= 1 - hidden * hidden
    gv = gh @ w["m"].T
    rows, back = np.unique(x, return_inverse=True)
    back = back.reshape(x.shape)
    sums = np.zeros((len(rows), EMBEDDING))
    for d in range(EMBEDDING):
        sums[:, d] = np.bincount(back.ravel(), gv[:, d::EMBEDDING].ravel(), len(rows))
    return {"v": (rows, sums.astype(gv.dtype)), "m": near.T @ gh, "b": gh.sum(0), "o": hidden.T @ g, "c": g.sum(0), "u": gu, "p": gp}


def train_on(w: dict, vocabulary: Vocabulary, x: np.ndarray, y: np.ndarray, sums: dict) -> None:
    """Adagrad steps over the batches of (x, y), in place; sums holds the squares so far."""
    for i in range(0, len(y), BATCH):
        for k, grad in gradients(w, vocabulary, x[i : i + BATCH], y[i : i + BATCH]).items():
            rows, grad = grad if k == "v" else (slice(None), grad)
            sums[k][rows] += grad * grad
            w[k][rows] -= RATE * grad / (np.sqrt(sums[k][rows]) + 1e-6)


def _words(part, at: int):
    raw, offsets = kernels.string_views(part.column(at))
    h, begin, end, first = kernels.hash_words(raw, offsets, kernels.SPACE_WORDS)
    return h, ending(raw, begin, end) if len(h) else np.zeros(0, np.int64), first


def _count(batches):
    """(word, kind of ending, count), summed over a slice of texts before anything moves."""
    for batch in batches:
        for part in kernels.slices(batch, "text", 8 << 20):
            h, kinds, _ = _words(part, 0)
            order = np.argsort(h)
            h = h[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            n = np.diff(np.r_[new, len(h)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(kinds[order[new]], pa.int64()), pa.array(n, pa.int64())], names=["word", "ending", "n"]
            )


def _counted(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, ending) of every word of the corpus."""
    rows = docs.select("text").mapInArrow(kernels.tidied(_count), "word long, ending long, n long")
    return scratch.save(rows.groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")), "counts")


def _crossing(rows: DataFrame, key, room: int, down: bool):
    """(key at which a running count of the rows passes ``room``, room left before it); the key is null where all fit."""
    for r in sorted(rows.groupBy(key.alias("k")).agg(F.count("*").alias("c")).collect(), reverse=down):
        if r.c > room:
            return r.k, room
        room -= r.c
    return None, room


def _most_frequent(counts: DataFrame) -> pa.Table:
    """The COUNTED rows of the greatest n, ties by word, in descending order.

    Where they end comes from histograms, of n in eighths of a power of two, then of n itself, then of the
    words' first bits, so the corpus is never sorted, no task sends candidates of its own, and what
    reaches the driver beyond the list is one bucket of words of equal n.
    """
    eighth = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    bits = F.shiftright("word", 44)
    top = counts
    k, room = _crossing(counts, eighth, COUNTED, True)
    if k is not None:
        n, room = _crossing(counts.where(eighth == k), F.col("n"), room, True)
        b, _ = _crossing(counts.where(F.col("n") == n), bits, room, False)
        top = counts.where((F.col("n") > n) | ((F.col("n") == n) & (bits <= b)))
    return top.select("word", "n", "ending").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).slice(0, COUNTED)


def _listed(counts: DataFrame) -> Vocabulary:
    """The driver gets COUNTED words, with those of one bucket more, and a row for each kind of ending."""
    top = _most_frequent(counts)
    words, n, endings = (top.column(k).to_numpy() for k in ("word", "n", "ending"))
    totals = np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        totals[r.ending] = r.n
    return Vocabulary(words.view(np.uint64), n, endings, totals)


def count_words(docs: DataFrame, scratch: Scratch) -> Vocabulary:
    """Counts over the whole corpus."""
    counts = _counted(docs, scratch)
    vocabulary = _listed(counts)
    scratch.drop(counts)
    return vocabulary


def _local_training(vocabulary: Vocabulary, weights: dict, turn: int):
    def run(batches):
        w = {k: v.copy() for k, v in weights.items()}
        sums = {k: np.zeros_like(v) for k, v in w.items()}
        seen, rng = 0, np.random.default_rng(turn)
        for batch in batches:
            for part in kernels.slices(batch, "text", SEEN_BYTES):
                h, kinds, first = _words(part, 0)
                symbols, *_ = vocabulary.encode(h, kinds)
                masked = rng.permutation(np.flatnonzero(rng.integers(0, MASK, len(h)) == 0))
                train_on(w, vocabulary, contexts(symbols, first, vocabulary.pad, masked), symbols[masked], sums)
                seen += len(masked)
        if seen:
            flat = np.concatenate([v.ravel() for v in w.values()])
            for i in range(0, len(flat), CHUNK):
                yield _chunk(i // CHUNK, flat[i : i + CHUNK] * np.float32(seen), seen)

    return run


def _chunk(at: int, total: np.ndarray, seen: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([float(seen)])], names=["at", "sum", "seen"])


def _summed(part: pa.Table) -> pa.Table:
    """One chunk of the tasks' weights, summed."""
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in part.column("sum"))
    return pa.Table.from_batches([_chunk(part.column("at")[0].as_py(), total, sum(part.column("seen").to_pylist()))])


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The averaged network after ROUNDS rounds over all documents."""
    weights = start(vocabulary)
    for turn in range(ROUNDS):
        work = _local_training(vocabulary, weights, turn)
        parts = docs.select("text").mapInArrow(kernels.tidied(work), "at int, sum binary, seen double")
        got = parts.groupBy("at").applyInArrow(_summed, "at int, sum binary, seen double").collect()  # one network
        if got:
            flat = np.concatenate([np.frombuffer(r["sum"], np.float32) / r["seen"] for r in sorted(got, key=lambda r: r["at"])]).astype(np.float32)
            done = 0
            for name, old in list(weights.items()):
                weights[name] = flat[done : done + old.size].reshape(old.shape)
                done += old.size
    return weights


def _score(vocabulary: Vocabulary, weights: dict, text_at: int, width: int, with_text: bool):
    #: what each neighbour's symbol adds to the hidden layer
    layer = [weights["v"] @ weights["m"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(2 * SIDE)]

    def run(batches):
        for batch in batches:
            for part in kernels.slices(batch, batch.schema.names[text_at], 1 << 20):
                h, kinds, first = _words(part, text_at)
                symbols, logs, missing = vocabulary.encode(h, kinds)
                x, logs = contexts(symbols, first, vocabulary.pad), logs.astype(np.float64)
                for i in range(0, len(h), 16384):
                    some = slice(i, i + 16384)
                    a = layer[0][x[some, 0]]
                    a += weights["b"]
                    for k in range(1, 2 * SIDE):
                        a += layer[k][x[some, k]]
                    logs[some] += log_probabilities(weights, vocabulary, np.tanh(a, out=a), symbols[some])
                total = np.zeros(part.num_rows)
                texts = np.flatnonzero(np.diff(first))
                if len(texts):
                    total[texts] = np.add.reduceat(logs, first[texts])
                at = np.flatnonzero(missing)
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), pa.array(h[at].view(np.int64)))
                kept = list(part.columns[:width])
                if not with_text:
                    kept[text_at] = pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first), pa.int64()), pa.array(total), rest], names=batch.schema.names)

    return run


def _with_rest(out: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds log n(word) of every word in lf_rest to its row's lf_log.

    Such a word is at most one in COUNTED of all tokens, so no key of the join is heavy. Rows that are alike in all columns are summed together: their number divides again.
    """
    words = out.where(F.size("lf_rest") > 0).select("lf_row", F.explode("lf_rest").alias("word"))
    sums = words.join(counts.select("word", F.log("n").alias("lf_n")), "word").groupBy("lf_row").agg(F.sum("lf_n").alias("lf_sum"))
    times = out.groupBy("lf_row").agg(F.count("*").alias("lf_times")).where("lf_times > 1")
    share = F.coalesce(F.col("lf_sum"), F.lit(0.0)) / F.coalesce("lf_times", F.lit(1))
    return out.join(sums, "lf_row", "left").join(times, "lf_row", "left").withColumn("lf_log", F.col("lf_log") + share)


def score_documents(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with a struct ``lm`` (``lm_1``, ... if docs has that name): n_tokens, log_prob and per_token.

    log_prob sums log P(token | both sides) over all tokens of the whole text, per_token is its mean. A
    null or wordless text has no tokens, log_prob 0 and a null per_token. Every row is scored; equal texts
    get equal scores; an empty table stays empty. Without ``with_text`` the texts of the result are null. The network depends on how the rows are dealt to tasks, as each
    task trains on its own; the counts do not.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = _counted(texts, scratch)
    vocabulary = _listed(counts)
    weights = train(texts, vocabulary)
    k, name = 0, "lm"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"lm_{k + 1}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    out = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    plain = [f.name for f in out.schema.fields if isinstance(f.dataType, T.AtomicType)]
    out = out.select("*", F.xxhash64(*plain).alias("lf_row"))
    out = out.select("*", F.lit(0).cast("long").alias("lf_n"), F.lit(0.0).alias("lf_log"), F.array().cast("array<bigint>").alias("lf_rest"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    out = out.mapInArrow(kernels.tidied(_score(vocabulary, weights, names.index(text), len(names) + 1, with_text)), schema)
    if len(vocabulary.lookup.keys) > COUNTED:  # as many as it may hold, so there may be others
        out = _with_rest(scratch.save(out, "scored"), counts)
    out = out.withColumn("lf_log", F.round("lf_log", 3))
    answer = F.struct(
        F.col("lf_n").alias("n_tokens"), F.col("lf_log").alias("log_prob"),
        F.when(F.col("lf_n") > 0, F.round(F.col("lf_log") / F.col("lf_n"), 6)).alias("per_token"),
    )
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], answer.alias(name))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col("lm.n_tokens").alias("n_tokens"), F.col("lm.log_prob").alias("log_prob"), F.col("lm.per_token").alias("per_token"))
