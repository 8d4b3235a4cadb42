import hashlib
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from larkfield.functions import nested
from larkfield.operators import digest, filters, triples
from larkfield.plans import catalog
from larkfield.sources import ledger_table, paged
from larkfield.streaming import ledger as streams

META = [
    {"crop": "Rice", "measurements": {"EC": {"value": 1.0}}, "tags": ["A", ["b", None]], "dataset": "one", "also_seen_in": [{"dataset": "Two"}, {"dataset": ["three"]}]},
    {"crop": ["Rice", "Maize"], "measurements": [{"EC": {"value": 2.5}}, {"EC": {"value": True}}], "dataset": {"name": "one"}},
    {"crop": None, "it's": "x"},
    {},
]


def test_nested_metadata(spark):
    rows = [(k, json.dumps(m)) for k, m in enumerate(META)] + [(8, "no json"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id int, j string").withColumn("meta", nested.parsed(F.col("j")))
    for meta, want in [
        ({"crop": "rice"}, {0, 1}), ({"crop": ["MAIZE", "x"]}, {1}), ({"measurements.EC.value": 1}, {0}), ({"measurements.EC.value": [1.0, True]}, {0, 1}),
        ({"measurements.EC.value": 2.50}, {1}), ({"measurements.EC": "1"}, set()), ({"tags": "B"}, {0}), ({"dataset": "two"}, {0}), ({"dataset": "three"}, {0}),
        ({"dataset": "one"}, {0}), ({"crop": []}, set()), ({"crop": None}, set()), ({"crop": "rice", "tags": "a"}, {0}), ({"nowhere.at.all": "x"}, set()),
    ]:
        assert {r.doc_id for r in filters.allowed(docs, meta=meta).collect()} == want, meta
    with pytest.raises(ValueError):
        nested.values(F.col("meta"), "it's")
    plain = docs.withColumn("crop", F.lit("wheat"))
    assert filters.allowed(plain, meta={"crop": "rice"}).count() == 0  # a column goes before a path
    assert filters.allowed(docs.limit(0), meta={"crop": "rice"}).count() == 0


def log(spark, rows):
    return spark.createDataFrame(rows, "site string, day string, status string, outcome string")


def files(root):
    return {p: p.stat().st_mtime_ns for p in (root / "data").rglob("*.parquet")}


def test_ledger_table(spark, tmp_path):
    root = tmp_path / "t"
    make = lambda: ledger_table.LedgerTable(spark, f"file://{root}", ["site", "day"], buckets=8)
    t = make()
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.settle(log(spark, [("a", "1", "", "o")])) == 0
    first = [(f"s{k}", "1", "pending", None) for k in range(40)] + [(None, "1", "pending", None)]
    assert t.append(log(spark, first + first), [F.col("outcome")], "x", 0) == 1 and t.read().count() == 41
    assert t.append(log(spark, [("other", "9", "pending", None)]), [F.col("outcome")], "x", 0) == 1  # a batch that was committed
    assert t.append(log(spark, first + [("s0", "2", "pending", None)]), [F.col("outcome")], "x", 1) == 2
    assert t.read().count() == 42 and t.read(1).count() == 41
    before = files(root)
    version = t.settle(log(spark, [("s3", "1", "", "good"), ("s4", "1", "", " "), ("gone", "1", "", "x")]).select("site", "day", "outcome"))
    assert version == 3 and all(files(root)[p] == at for p, at in before.items())
    assert [tuple(r) for r in t.read().where("status = 'settled'").collect()] == [("s3", "1", "settled", "good")] and t.read().count() == 42
    old, new = t.state(2)["folders"], t.state(3)["folders"]
    assert sum(old[b] != new[b] for b in old) == 1  # one bucket alone was written
    assert t.settle(log(spark, [("s3", "1", "", "again")]).select("site", "day", "outcome")) == 3  # nothing is pending there
    assert t.compact(1) == 4 and t.read().count() == 42 and all(len(f) == 1 for f in t.state()["folders"].values())
    with pytest.raises(ValueError):
        t.append(log(spark, first).withColumn("more", F.lit(1)), [F.col("outcome")])
    with pytest.raises(ValueError):
        ledger_table.LedgerTable(spark, f"file://{root}", ["site"], buckets=8).read()
    assert t.append(log(spark, []), [F.col("outcome")]) == 5 and t.read().count() == 42


def test_two_writers(spark, tmp_path, monkeypatch):
    make = lambda: ledger_table.LedgerTable(spark, f"file://{tmp_path}/t", ["site", "day"], buckets=4)
    one, two = make(), make()
    one.append(log(spark, [("a", "1", "pending", None)]), [F.col("outcome")])
    write, done = two._write, []

    def late(rows):  # the other writer commits while this one writes
        if not done:
            done.append(one.append(log(spark, [("b", "1", "pending", "first"), ("c", "1", "pending", None)]), [F.col("outcome")]))
        return write(rows)

    monkeypatch.setattr(two, "_write", late)
    assert two.append(log(spark, [("b", "1", "pending", "second"), ("d", "1", "pending", None)]), [F.col("outcome")]) == 3
    assert sorted((r.site, r.outcome or "") for r in one.read().collect()) == [("a", ""), ("b", "first"), ("c", ""), ("d", "")]
    kept = {f for v in (1, 2, 3) for held in one.state(v)["folders"].values() for f in held}
    assert {f"data/{p.name}" for p in (tmp_path / "t" / "data").iterdir()} == kept  # what was written in vain is gone
    monkeypatch.undo()
    two.attempts = 1
    state = two.state()
    one.append(log(spark, [("e", "1", "pending", None)]), [F.col("outcome")])
    monkeypatch.setattr(two, "state", lambda version=None: state)
    with pytest.raises(ledger_table.Conflict):
        two.append(log(spark, [("f", "1", "pending", None)]), [F.col("outcome")])
    assert one.read().count() == 5


def test_stream_into_a_ledger(spark, tmp_path):
    source, mark = tmp_path / "in", tmp_path / "mark"
    source.mkdir()
    t = ledger_table.LedgerTable(spark, f"file://{tmp_path}/t", ["site", "day"], buckets=4)

    def run(checkpoint):
        rows = streams.ledger_stream(spark, str(source), "site string, day string, status string, outcome string")
        q = streams.to_ledger(rows, t, [F.col("outcome")], "events", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    (source / "1.json").write_text('{"site": "a", "day": "1", "status": "pending"}\n{"site": "a", "day": "1", "status": "pending"}\n')
    run(mark)
    (source / "2.json").write_text('{"site": "b", "day": "1", "status": "pending"}\n')
    run(mark)
    assert sorted(r.site for r in t.read().collect()) == ["a", "b"] and t.state()["streams"] == {"events": 1}
    version = t.version()
    for name in (mark / "commits").iterdir():  # as if the last batch had failed after it was committed to the table
        if name.name.lstrip(".").startswith("1"):
            name.unlink()
    run(mark)
    assert t.version() == version and t.read().count() == 2


def test_set_digest(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, "ä"), (3, "", "1:x")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashes = [hashlib.sha256("".join(map(field, r)).encode()).hexdigest() for r in rows]
    sums = [sum(int(h[8 * k: 8 * k + 8], 16) for h in hashes) for k in range(8)]
    want = hashlib.sha256(",".join(map(str, [4, *sums])).encode()).hexdigest()
    columns = ["k", "a", "b"]
    assert [tuple(r) for r in digest.set_digest(df.repartition(3), columns).collect()] == [(4, want)]
    parts = digest.states(df, columns, ["k"])
    assert digest.digests(digest.merged(parts)).first().digest == want
    assert digest.set_digest(df.distinct(), columns).first().digest != want
    empty = digest.set_digest(df.limit(0), columns).first()
    assert empty.n == 0 and empty.digest == hashlib.sha256(b"0,0,0,0,0,0,0,0,0").hexdigest()


def test_triples(spark):
    rows = [("c1", triples.PREFERRED, "rice", "en"), ("c1", triples.ALTERNATIVE, "paddy", "en"), ("c1", triples.PREFERRED, "riz", "fr"), ("c2", triples.ALTERNATIVE, "rice", "de"),
            ("c2", triples.PREFERRED, "Reis", "de"), ("c3", "same", "c3", ""), ("c3", "same", "c1", ""), (None, "same", None, "")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, lang string")
    got = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    asked = spark.createDataFrame([("rice", "en"), ("rice", "en"), ("none", "en")], "label string, lang string")
    assert got(triples.concept_labels(t, asked, ["en", "de"])) == got(spark.createDataFrame([("rice", "en", "en", "rice"), ("rice", "en", "de", "Reis"), ("none", "en", None, None)], "a string, b string, c string, d string"))
    assert [r.x for r in triples.match(t, [("?x", "same", "?x")]).collect()] == ["c3"]
    assert got(triples.match(t, [("?a", "same", "?b"), ("?b", triples.PREFERRED, "?n")]).select("a", "n")) == ["('c3', 'rice')", "('c3', 'riz')"]
    more = triples.optional(triples.match(t, [("?b", triples.PREFERRED, "?n", "en")]), t, [("?b", triples.PREFERRED, "?o", "de")])
    assert [(r.b, r.n, r.o) for r in more.collect()] == [("c1", "rice", None)]
    for bad in ([("?a", "same", "?b"), ("?c", "same", "?d")], [("c3", "same", "c1")], []):
        with pytest.raises(ValueError):
            triples.match(t, bad)


@pytest.fixture
def service():
    """250 rows in pages of 40 at most; every third request fails once, and offset 666 has a lie about its rows."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append((q["offset"], q["length"]))
            if len(asked) % 3 == 0:
                self.send_error(503)
                return
            rows = [{"row": {"id": k, "text": f"t{k}", "more": 1}} for k in range(q["offset"], min(q["offset"] + min(q["length"], 40), 250))]
            body = json.dumps({"rows": rows, "num_rows_total": q.get("total", 250)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?offset={{offset}}&length={{length}}", asked
    server.shutdown()


def test_paged_source(spark, service):
    url, asked = service
    schema = "id long, text string, gone string"
    df = paged.read_paged(spark, url, schema, page=30, pages_per_task=2, wait=0.01)
    assert df.rdd.getNumPartitions() == 5 and sorted((r.id, r.text, r.gone) for r in df.collect()) == [(k, f"t{k}", None) for k in range(250)]
    asked.clear()
    some = paged.read_paged(spark, url, schema, limit=70, page=50, pages_per_task=1, wait=0.01)
    assert sorted(r.id for r in some.collect()) == list(range(70)) and max(at + n for at, n in asked) == 70
    assert paged.read_paged(spark, url, schema, limit=0, wait=0.01).count() == 0
    with pytest.raises(Exception, match="no rows at 250"):
        paged.read_paged(spark, url + "&total=300", schema, wait=0.01).collect()
    with pytest.raises(Exception, match="offset"):
        paged.read_paged(spark, "http://127.0.0.1:1/", schema).collect()


@pytest.mark.parametrize("name", ["nested_props", "nested_documents", "set_digests", "thesaurus_labels", "graph_patterns"])
def test_native(spark, sf, name):
    p = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop|collect_list", p)


def test_tasks_of_concept_labels_are_bounded(spark, monkeypatch):
    """Concepts are joined in as many partitions as there are rows for, and none of these are merged."""
    from larkfield.operators import triples

    monkeypatch.setattr(triples, "TASK_ROWS", 100)
    rows = [(f"c{k}", p, f"{p}{k % 7}", "en") for k in range(400) for p in (triples.PREFERRED, triples.ALTERNATIVE)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, lang string")
    asked = spark.createDataFrame([(f"{triples.ALTERNATIVE}3", "en"), ("none", "en")], "label string, lang string")
    out = triples.concept_labels(t, asked, ["en"])
    dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x and ", 8)" in x]
    assert sum("hashpartitioning(concept" in x for x in dealt) == 2 and sum("hashpartitioning(label" in x for x in dealt) == 2
    assert sorted(map(tuple, out.collect()), key=str) == [("none", "en", None, None), (f"{triples.ALTERNATIVE}3", "en", "en", f"{triples.PREFERRED}3")]
