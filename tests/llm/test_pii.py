import random
import re

from larkfield.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            return 12 <= len(digits) <= 19 and pii.luhn(digits)
        return 9 <= len(digits) <= 15 if kind == 3 else True

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m[0]))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    parts = ["a@b.co", "@", "x.y_z%+-", "1.2.3.4", "256.1.1.1", "0255.1.1.1.9.9.9", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 010-9999", "+", "12345678901", ".", " ", "-", "é", "😀", "(", ")", "\n", "00", "@@a.b", "a@b@c.d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for unit in ("1", "a", "1.", "1 ", "+1(", "a@", "@", "a.b@c."):
        pii.base_spans(unit * 60_000)
        list(pii.candidates(unit * 60_000, []))


def test_em_finds_reliable_labelers():
    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = [0] * len(pii.LABELERS)
        for k, right in ((0, 0.95), (1, 0.9), (5, 0.65)):
            if rng.random() < 0.8:
                votes[k] = 1 if truth == (rng.random() < right) else 2
        code = 0
        for v in votes:
            code = 3 * code + v
        counts[(code, False)] = counts.get((code, False), 0) + 1
    share, right, post = pii.reliabilities(counts)
    got = list(right.values())
    assert abs(share - 0.4) < 0.06 and abs(got[0] - 0.95) < 0.05 and abs(got[1] - 0.9) < 0.05 and abs(got[5] - 0.65) < 0.1
    assert all(0 <= p <= 1 for p in post.values())


def test_a_candidate_that_nothing_speaks_for_is_never_taken():
    for n in (1, 100, 10**7):
        share, _, post = pii.reliabilities({(0, False): n, (1, True): n})
        assert share <= 0.5 and post[0] < pii.ACCEPT
    right = dict(pii.LABELERS)
    w = pii.fit_spans([([1, 5], 0, 0.95, 40), ([2, 5], 0, 0.03, 60)], 0.3, right)
    assert w[pii._slots([1, 5], 0)].sum() > w[pii._slots([2, 5], 0)].sum()


YES = ["call 555-010-9999 today", "my phone is (555) 010-9999", "write to jane.doe [at] example [dot] org", "Dr. Maria Lopez said", "name: Peter Huber, yes"]
NO = ["order 4929 1234 5678 9013 came", "version 1234567 of it", "ISBN 9781234567897 here", "the sum 5555555555 again", "in 2019 2020 2021 2022 it was"]


def test_planted_spans_and_decoys_at_any_size(spark):
    """The same spans whether the corpus is small or large, and whatever decoys outnumber what."""
    schema = "doc_id long, text string"
    for yes, no, plain in ((1, 1, 0), (40, 1, 50), (1, 60, 10), (30, 30, 30)):
        texts = YES * yes + NO * no + ["and no data at all"] * plain + ["mail a@b.co or +1 (555) 010-9999", "4111 1111 1111 1111"]
        df = spark.createDataFrame(list(enumerate(texts)), schema)
        model = pii.train(df)
        got = {r.text: [s.kind for s in r.pii.spans] for r in pii.find_pii(df, model).collect()}
        assert all(len(got[t]) == 1 and got[t][0] > 3 for t in YES), (yes, no, [t for t in YES if not got[t]])
        assert all(got[t] == [] for t in NO), (yes, no, [t for t in NO if got[t]])
        # by brute force: every span that the model accepts of every candidate, and the base spans
        for r in pii.find_pii(df, model).collect():
            base = brute(r.text)
            added = [(s, k, e) for s, k, e in pii.candidates(r.text, base) if model.probability(r.text, s, k, e) >= pii.ACCEPT]
            assert [(s.start, s.kind, s.end) for s in r.pii.spans] == sorted(base + added)
        assert set(model.right) == set(pii.LABELERS)


def test_names_from_a_file(spark, tmp_path, monkeypatch):
    (tmp_path / "names.txt").write_text("Xyzzy\n\n  Quux \n")
    names = pii.load_names(spark, str(tmp_path))
    assert names == {"xyzzy", "quux"}
    df = spark.createDataFrame([(1, "so Dr. Xyzzy Blue said"), (2, "so Dr. Maria Blue said")], "doc_id long, text string")
    got = {r.doc_id: len(r.pii.spans) for r in pii.find_pii(df, pii.train(df, names=names)).collect()}
    assert got == {1: 1, 2: 0}
    monkeypatch.setattr(pii, "MOST_NAMES", 1)
    try:
        pii.load_names(spark, str(tmp_path))
        raise AssertionError
    except ValueError:
        pass


def test_operator(spark):
    texts = ["mail a.b@c-d.org now", None, "", "call tel (555) 010-9999 please", "é😀 4111 1111 1111 1111 and 10.0.0.1", "nothing", "Dr. Maria Lopez said"] + ["phone 555-010-9999 is mine"] * 30 + ["version 1234567 of 2019"] * 30
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    w = pii.train(df)
    out = pii.find_pii(df, w)
    assert out.columns[-1] == "pii_1" and out.count() == len(texts)
    for r in out.collect():
        got = [(s.start, s.kind, s.end) for s in r.pii_1.spans]
        assert [s for s in got if s[1] < 4] == brute(r.text or "")
        assert r.pii_1.redacted == (pii.redact(r.text, got) if r.text is not None else None)
    assert out.where("doc_id = 4").first().pii_1.redacted == "é😀 <CARD> and <IP>"
    assert {r.pii_1.redacted for r in out.where("text = 'nothing'").collect()} == {"nothing"}
    none = spark.createDataFrame([], df.schema)
    assert pii.train(none) is None and pii.find_pii(none, None).collect() == []


def test_query(spark, sf):
    from larkfield.llm import registry

    rows = {r.doc_id: r for r in registry.QUERIES["op6_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = brute(r.text)
        assert [rows[r.doc_id][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == k for s in want) for k in range(4)]
