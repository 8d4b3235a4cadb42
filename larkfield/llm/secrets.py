"""Secret scans: fixed patterns, and character Markov models for anything else that looks random.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained on
labelled samples made from seeds and word lists. A token that the patterns left alone is a secret if its
log-likelihood ratio between the two is at least ``THRESHOLD``. Everything is DataFrame functions; a scan
needs no shuffle, and what training brings to the driver is one number for each pair of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkfield.runtime import read_table

#: fixed patterns of the base kinds, in the order in which kinds are listed
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of [0-9a-f]+ that has 32 characters at least
KINDS = ("assign", "access", "hex", "model")
#: what the models judge: runs of these characters, 16 or more
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
THRESHOLD = 15.0
SMOOTHING = 0.5
SAMPLES = 4000

#: words that ordinary identifiers are made of
WORDS = (
    "account action active address agent archive array article backup batch block branch buffer build button cache "
    "category change chapter client cluster column command comment config content context count create current "
    "customer data database date default delete detail device document domain edit element email enable entry error "
    "event export field file filter folder format function group handler header history image import index info input "
    "item job key label language layout level library limit line link list local log main manager map member message "
    "method model module month name network node note number object option order output owner package page panel "
    "parameter parent password path pattern payment percent period person picture point policy position price process "
    "product profile project property query queue range record region release report request resource response result "
    "return role root route row rule sample schema score screen script search section select server service session "
    "setting shape size source space stage start state status step storage stream string style submit summary system "
    "table target task temp test text theme thread time title token total track type update upload user utils value "
    "vector version view width window worker year"
).split()


def _samples(spark: SparkSession) -> DataFrame:
    """(text, random): labelled samples, the same on every run."""
    n = F.col("id")
    digest = lambda k: F.sha2(F.concat(F.lit(f"s{k}:"), n.cast("string")), 256)
    base64 = F.base64(F.unhex(digest(1)))
    plain = F.regexp_replace(F.base64(F.unhex(digest(2))), "[+/=]", "")
    random = F.array(F.substring(digest(3), 1, 40), base64, F.substring(plain, 1, 32), F.substring(F.upper(plain), 5, 28))
    words = F.split(F.lit(" ".join(WORDS)), " ")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), n), F.lit(len(WORDS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(F.lit(9), n), F.lit(2030)).cast("string")
    plain = [F.concat(word(k), F.initcap(word(k + 1)), F.initcap(word(k + 2)), number) for k in (10,)]
    ordinary = F.array(
        *plain,
        F.concat_ws("_", word(20), word(21), word(22), number),
        F.concat_ws("-", word(30), word(31), number, word(32)),
        F.upper(F.concat_ws("_", word(40), word(41), word(42), number)),
        F.concat_ws("/", word(50), word(51), word(52), F.concat(word(53), number)),
        F.concat(word(60), word(61), word(62)), F.concat(F.initcap(word(63)), word(64), word(65)), F.upper(F.concat(word(66), word(67), word(68))),
        F.concat_ws("-", word(70), word(71), word(72)), F.repeat(F.substring(F.lit("-=_+"), (n % 4 + 1).cast("int"), F.lit(1)), (n % 40 + 16).cast("int")),
        F.lpad(F.abs(F.xxhash64(F.lit(80), n)).cast("string"), 18, "7"),
    )
    ids = spark.range(SAMPLES)
    pick = lambda options, label: ids.select(F.explode(options).alias("text"), F.lit(label).alias("random"))
    return pick(random, True).unionByName(pick(ordinary, False))


def train_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every pair of ASCII characters, at 128 * first + second; 0 starts a string."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split("text", ""), lambda c: F.ascii(c)))
    codes = F.filter(codes, lambda c: c < 128)
    pairs = samples.select("random", F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes)).alias("b")).alias("p"))
    pairs = pairs.select("random", F.explode("p").alias("p")).select("random", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    counts = pairs.where("b > 0").groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()  # 2 * 128 * 128 rows at most
    by = {(r.random, r.a, r.b): r.n for r in counts}
    alphabet = sorted({b for _, _, b in by})
    import math

    out = [0.0] * (128 * 128)
    for a in [0, *alphabet]:
        total = {k: sum(by.get((k, a, b), 0) for b in alphabet) + SMOOTHING * len(alphabet) for k in (True, False)}
        for b in alphabet:
            p, q = ((by.get((k, a, b), 0) + SMOOTHING) / total[k] for k in (True, False))
            out[128 * a + b] = round(math.log(p / q), 4)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located_blocks(text: Column, pattern: str) -> Column:
    """Runs of (text, start, end) of every match, leftmost and non-overlapping, in code points; n matches in about sqrt(n) runs.

    Starts are sums of what lies before: first of whole runs, then within each. So a text of many matches costs n * sqrt(n)
    at most, not n * n.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "array<array<struct<text:string,start:int,end:int>>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(x["m"].alias("text"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def begin(at):
        return F.struct(at.alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("spans"))

    def before(acc, x):
        return F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), x["run"].alias("run")))).alias("runs"))

    def runs(z):
        size = F.ceil(F.sqrt(F.size(z).cast("double"))).cast("int")
        cut = F.transform(F.sequence(F.lit(1), F.size(z), size), lambda i: F.slice(z, i, size))
        summed = F.transform(cut, lambda run: F.struct(F.aggregate(run, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["m"])).alias("n"), run.alias("run")))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,run:array<struct<m:string,gap:string>>>>").alias("runs"))
        return F.transform(F.aggregate(summed, none, before, lambda acc: acc["runs"]), lambda r: F.aggregate(r["run"], begin(r["at"]), step, lambda acc: acc["spans"]))

    zipped = _let(found, lambda m: F.zip_with(m, F.slice(between, 1, F.greatest(F.size(m), F.lit(1))), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))))
    zipped = F.filter(zipped, lambda x: x["m"].isNotNull())
    return F.when(F.rlike(text, F.lit(pattern)), _let(zipped, runs)).otherwise(F.array().cast(kind))


def located(text: Column, pattern: str) -> Column:
    """(text, start, end) of every match, in order."""
    return F.flatten(located_blocks(text, pattern))


def scan_secrets(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with an array ``secrets`` of (start, kind, end) at the end, by start and then by kind.

    kind is a place in ``KINDS``; starts count code points and ends are exclusive. A null text counts as
    empty and has none. Spans of the models never overlap those of the patterns. If docs has a column
    ``secrets`` already, the result's is called ``secrets_1`` (and so on). Rows are never dropped.
    """
    ratios = train_ratios(_samples(docs.sparkSession))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    k, name = 0, "secrets"
    while name.lower() in {c.lower() for c in docs.columns}:
        k, name = k + 1, f"secrets_{k + 1}"
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit(""))

    def spans(pattern, kind, keep):
        return F.transform(F.filter(located(text, pattern), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(
        spans(ASSIGN, 0, lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 8),
        spans(ACCESS, 1, lambda s: F.length(s["text"]) >= 16),
        spans(HEX, 2, lambda s: F.length(s["text"]) >= 32),
    )

    def ratio(token):
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
        pairs = _let(codes, lambda x: F.zip_with(F.concat(F.array(F.lit(0)), x), x, lambda a, b: F.coalesce(a * 128 + b, F.lit(0))))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, at: acc + F.coalesce(F.get(F.col("lf_ratios"), at), F.lit(0.0)))

    out = out.withColumn("lf_ratios", table).withColumn("lf_base", base)
    over = lambda spans, start, end: F.filter(spans, lambda b: (b["start"] < end) & (start < b["end"]))

    def judged(run, near):
        """The tokens of a run that the models find and none of the patterns' spans near it touches."""
        fit = F.filter(run, lambda s: (F.size(over(near, s["start"], s["end"])) == 0) & (ratio(s["text"]) >= threshold))
        return F.transform(fit, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))

    def model_of(base):
        first, last = (lambda run: F.element_at(run, 1)["start"]), (lambda run: F.element_at(run, -1)["end"])
        return F.flatten(F.transform(located_blocks(text, CANDIDATE), lambda run: _let(over(base, first(run), last(run)), lambda near: judged(run, near))))

    model = model_of(F.col("lf_base"))
    found = F.array_sort(F.concat("lf_base", model))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], found.alias(name))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["kind"] < 3), KINDS), 256).alias("base_sha256"),
        joined(s, KINDS).alias("spans"),
    )
