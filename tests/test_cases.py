from datetime import date

import pytest
from pyspark.sql import functions as F

from larkfield.operators import domain, ledger, routing, series
from larkfield.sources.errors import NoDataError, RateLimitError


def test_as_of(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-01-20", "2024-01-12"), ("2024-01-15", "2024-01-20", "2024-01-12"), ("2024-01-01", "2024-01-02", "2024-01-12")], "s string, e string, a string")
    got = [tuple(r.w) for r in df.select(series.as_of_window(F.col("s"), F.col("e"), F.col("a")).alias("w")).collect()]
    assert got == [("2024-01-05", "2024-01-12"), ("2024-01-12", "2024-01-12"), ("2024-01-01", "2024-01-02")]


def test_half_open_window(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-05 00:00:00'), (TIMESTAMP '2024-01-06 23:59:59'), (TIMESTAMP '2024-01-07 00:00:00'), (CAST(NULL AS TIMESTAMP)) AS t(ts)")
    inside = lambda now: [r[0] for r in df.select(series.in_window(F.col("ts"), F.lit("2024-01-05"), F.lit("2024-01-06"), F.to_timestamp(F.lit(now)))).collect()]
    assert inside("2024-01-06 12:00:00") == [True, True, False, True] and inside("2024-02-01 00:00:00")[3] is False


def test_synthetic_series(spark):
    asked = spark.createDataFrame([("FIELD-07", "soil_moisture"), ("S", "odd")], "site_id string, channel string")
    rows = series.sensor_readings(asked, "2026-09-19", "2026-09-26").collect()
    assert len(rows) == 16 and {r.unit for r in rows} == {"%", "单位未知"}
    assert rows == series.sensor_readings(asked, "2026-09-19", "2026-09-26").collect()
    anchor = next(r.value for r in rows if r.channel == "soil_moisture" and r.day == series.ANCHOR)
    assert abs(anchor - 16.6) <= 0.3
    w = series.weather(asked, "2026-09-24", "2026-09-26")
    assert w.where("forecast").count() == 4 and w.where("NOT forecast AND low BETWEEN 20 AND 23 AND wind IN (2, 3)").count() == 6
    assert series.remote_sensing(asked.withColumn("index", F.lit("NDVI")), "2026-09-26", "2026-09-26").where("value BETWEEN 0.61 AND 0.65").count() == 2
    assert series.site_profile(" field-07 ")["crop"] == "番茄" and series.site_profile("x") == {} and 10 <= series.camera_ratio("a") <= 18


@pytest.mark.parametrize("window", [("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-03-03"), ("x", "2024-01-01")])
def test_bad_windows(spark, window):
    with pytest.raises(NoDataError):
        series.window_days(spark, *window)
    days = [r.day for r in series.window_days(spark, "2024-01-01", "2024-03-02").collect()]
    assert len(days) == 62 and (days[0], days[-1]) == (date(2024, 1, 1), date(2024, 3, 2))
    with pytest.raises(ValueError):
        series.validate_as_of("2024-01-02", date(2024, 1, 1))


def test_idempotent_append_and_settlement(spark):
    log = spark.createDataFrame([("s", "1", "pending", None), ("s", "2", "settled", "old"), ("t", "1", "pending", None)], "site string, day string, status string, outcome string")
    new = spark.createDataFrame([(1, "s", "1"), (2, "s", "3"), (3, "s", "3")], "n int, site string, day string")
    assert [r.n for r in ledger.to_append(new, log, ["site", "day"], [F.col("n")]).collect()] == [2]
    out = spark.createDataFrame([("s", "1", "good"), ("s", "2", "new"), ("t", "1", " ")], "site string, day string, outcome string")
    got = {(r.site, r.day): (r.status, r.outcome) for r in ledger.settle(log, out, ["site", "day"]).collect()}
    assert got == {("s", "1"): ("settled", "good"), ("s", "2"): ("settled", "old"), ("t", "1"): ("pending", None)}


def test_lessons(spark):
    rows = [(i, "s" if i % 2 else "o", "pending" if i == 19 else "settled", None if i == 17 else f"2024-01-{i + 1:02d}") for i in range(20)]
    log = spark.createDataFrame(rows, "n int, site string, status string, resolved_date string")
    assert sorted(r.n for r in ledger.past_context(log, "s", None, "n").collect()) == [9, 11, 13, 14, 15, 16, 17, 18]
    assert sorted(r.n for r in ledger.past_context(log, "s", "2024-01-10", "n").collect()) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_receipts_and_cases(spark):
    cmd = spark.createDataFrame([("s", "v", "open", "5", "w1")], "site_id string, actuator string, command string, params string, work_order_id string")
    live, dry = ledger.dispatch(cmd, False), ledger.dispatch(cmd, True)
    task = live.first().task_id
    assert task.startswith("SYN-") and dry.first().task_id is None and not dry.first().dispatched
    led = live.withColumn("seq", F.lit(1)).unionByName(dry.withColumn("seq", F.lit(2)))
    asked = spark.createDataFrame([("s", task), ("s", "no")], "site_id string, task_id string")
    assert {r.task_id: r.state for r in ledger.receipts(led, asked).collect()} == {task: "done", "no": "missing"}
    ev = spark.createDataFrame([("a", 1, "queued", None), ("a", 2, None, "r"), ("b", 3, "failed", None)], "case_id string, seq int, status string, report string")
    assert [tuple(r) for r in ledger.case_list(ledger.case_view(ev), "updated_seq").collect()] == [("b", 3, "failed", None), ("a", 2, "queued", "r")]
    with pytest.raises(ValueError):
        ledger.case_update({}, {"id": 1})


def test_routers(spark):
    df = spark.range(1)
    v = lambda c: df.select(c).first()[0]
    none = F.lit(None).cast("boolean")
    assert v(routing.after_screen(none)) == "diagnosis" and v(routing.after_screen(F.lit(False))) == "close_case" and v(routing.after_screen(F.lit(False), False)) == "diagnosis"
    nxt = lambda r, a, p=0, d=0: v(routing.coordinator_next(F.lit(r), F.lit(a), F.lit(p), F.lit(d)))
    assert nxt(4, "plan") == "close_case" and nxt(3, "perceive_more") == "perception" and nxt(1, "perceive_more", 1) == "work_order" and nxt(1, "diagnose_more", 0, 1) == "work_order" and nxt(1, "close") == "close_case"
    assert v(routing.after_safety(F.lit("revise"), F.lit(2))) == "coordinator" and v(routing.after_safety(F.lit("block"), F.lit(0))) == "coordinator"
    assert v(routing.after_execution(F.lit("failed"), F.lit(1))) == "finalize" and v(routing.after_approval(none)) == "coordinator"
    assert v(routing.final_status(F.lit("unknown"), F.lit(None).cast("string"))) == "executed" and v(routing.lifecycle(F.lit(False), F.lit(2))) == "paused"
    gate = lambda need, dry, human: tuple(v(routing.approval_gate(F.lit(need), F.lit(dry), human)))
    assert gate(True, True, none) == (False, True, "human") and gate(True, False, F.lit(True)) == (True, False, "human")
    assert gate(False, True, none) == (True, False, "dry run") and gate(False, False, none) == (True, False, "automatic")


def test_vendor_chain():
    def none(*a):
        raise NoDataError("x")

    def limited(*a):
        raise RateLimitError("x")

    def broken(*a):
        raise ZeroDivisionError

    reg = {"none": none, "limited": limited, "ok": lambda *a: a, "broken": broken}
    assert routing.route(["none", "limited", "missing", "ok", "broken"], reg, 7) == (7,)
    assert routing.route(["none"], reg, optional=True) is None
    with pytest.raises(NoDataError):
        routing.route(["none"], reg)
    with pytest.raises(ZeroDivisionError):
        routing.route(["broken", "ok"], reg)
    assert routing.chain("t", "c", {"t": " a, b,"}, {"c": "z"}) == ["a", "b"] and routing.chain("u", "c", {}, {"c": "z"}) == ["z"]


def test_rules(spark):
    rows = [("喷雾 灌溉", "百草枯 农药 毒死蜱"), ("检修", ""), ("巡田", None), ("灌溉", "肥")]
    got = [(r.hits, r.n_blocked, r.conclusion) for r in routing.check_rules(spark.createDataFrame(rows, "action string, materials string")).collect()]
    assert got == [(["R-101", "R-101", "R-301", "R-401", "R-202"], 2, "blocked"), (["R-501"], 0, "conditions"), ([], 0, "clear"), ([], 0, "clear")]


def test_budget(spark):
    calls = spark.createDataFrame([(1, i, t) for i, t in enumerate("aabbbcd")], "run int, turn int, tool string")
    assert [r.turn for r in routing.within_budget(calls, "run", "turn", "tool", {"a": 2, "b": 2}, total=5).orderBy("turn").collect()] == [0, 1, 2, 3, 5]


def test_card_links(spark):
    e = spark.createDataFrame([("e1", ["rot"], "S1", ["rice"]), ("e2", ["rot"], "S2", ["maize"]), ("e3", ["x"], "S3", ["rice"]), ("e4", ["both"], "S1", ["rice"])], "entity string, aliases array<string>, scientific string, crops array<string>")
    c = spark.createDataFrame([("c1", ["rot", "both"], "S1", ["rice"]), ("c2", ["both"], "S3", ["rice"]), ("c3", ["w"], "S2", ["maize"])], "disease_id string, aliases array<string>, scientific string, crops array<string>")
    assert {tuple(r) for r in domain.link_cards(e, c).collect()} == {("e1", "c1"), ("e2", "c3"), ("e3", "c2")}


def test_treatments_refuse_several_hosts(spark):
    plans = spark.createDataFrame([("p1", "management", "c:1", "d1", ["rot"], "rice"), ("p2", "treatment", "c:2", "d2", ["rot"], "maize"), ("p3", "management", "c:1", "d1", ["x"], None)],
                                  "doc_id string, kind string, parent_id string, disease_id string, names array<string>, host string")
    asked = spark.createDataFrame([(1, None, None, ["rot"], None), (2, None, None, ["rot"], "rice"), (3, "c:1", None, [], "rice"), (4, None, "d9", [], None)], "query_id int, parent_id string, disease_id string, names array<string>, crop string")
    assert {tuple(r) for r in domain.treatments(asked, plans).collect()} == {(1, "p1", True), (1, "p2", True), (2, "p1", False), (3, "p1", False)}


def test_agronomy(spark):
    d = spark.createDataFrame([
        ("a", "qa_pair", "Irrigation", "tomato irrigation: avoid excess watering", ["tomato"]), ("b", "qa_pair", "x", "irrigation of beds, apply 5 kg of salt", []), ("c", "qa_pair", "y", "tomato watering matters", ["tomato"]),
        ("d", "qa_pair", "z", "cucumber irrigation: avoid stress", ["cucumber"]), ("e", "disease_card", "w", "tomato irrigation avoid", ["tomato"]),
    ], "doc_id string, kind string, title string, text string, crops array<string>")
    q = spark.createDataFrame([(1, "tomato irrigation management", ["tomato"])], "query_id int, query_text string, crops array<string>")
    assert [(r.doc_id, r.crop_scope) for r in domain.agronomy(q, d).collect()] == [("a", "crop_matched")]
    decoys = spark.createDataFrame([(f"x{k}", "qa_pair", "irrigation management", "cucumber irrigation management: avoid irrigation irrigation", ["cucumber"]) for k in range(60)], d.schema)
    assert [r.doc_id for r in domain.agronomy(q, d.unionByName(decoys)).collect()] == ["a"]
    both = spark.createDataFrame([(1, "tomato irrigation management", ["tomato"]), (2, "how to treat tomato rot and irrigation", ["tomato"]), (3, "irrigation after transplanting", None)], q.schema)
    cards = spark.createDataFrame([("d1", ["tomato rot"], ["tomato"]), ("d2", ["rot"], ["maize"])], "disease_id string, names array<string>, crops array<string>")
    assert {tuple(r) for r in domain.named_diseases(both.where("crops is not null"), cards).collect()} == {(2, "d1", "tomato")}
    plans = spark.createDataFrame([("p1", "treatment", None, "d1", ["rot"], "tomato"), ("p2", "treatment", None, "d2", ["rot"], "maize")], "doc_id string, kind string, parent_id string, disease_id string, names array<string>, host string")
    docs = d.unionByName(spark.createDataFrame([("p1", "treatment", "t", "spray it", ["tomato"])], d.schema))
    got = {(r.query_id, r.doc_id, r.crop_scope) for r in domain.agronomy(both, docs, cards=cards, plans=plans).collect()}
    assert got == {(1, "a", "crop_matched"), (2, "p1", "crop_matched")}


def test_cards_of_documents(spark):
    cards = spark.createDataFrame([("c1", "d1", ["rot"], "rice", False), ("c2", "d2", ["rot", "wilt"], "maize", False), ("c3", "d3", ["wilt"], "maize", True)], "doc_id string, disease_id string, names array<string>, host string, demo boolean")
    asked = spark.createDataFrame([(1, None, "rot"), (2, None, "wilt"), (3, "d1", None), (4, "c3", None), (5, "no", "no")], "query_id int, disease_id string, name string")
    assert {tuple(r) for r in domain.anchor_cards(asked, cards).collect()} == {(2, "c2"), (3, "c1"), (4, "c3")}
    docs = spark.createDataFrame([("a", "d1", None, None), ("b", "zz", "p", None), ("c", None, "q", "e"), ("d", None, None, None)], "doc_id string, disease_id string, parent_id string, entity string")
    anchors, links = spark.createDataFrame([("p", "d2")], "parent_id string, disease_id string"), spark.createDataFrame([("e", "d3")], "entity string, disease_id string")
    assert {tuple(r) for r in domain.document_cards(docs, cards, anchors, links).collect()} == {("a", "d1"), ("b", "d2"), ("c", "d3")}


def test_scenarios(spark):
    got = spark.createDataFrame([("s1", "close", "Monitor", "all is dry"), ("s2", "plan", "Soon", "x")], "scenario string, action string, disposition string, notes string")
    want = spark.createDataFrame([("s1", ["close"], ["Monitor"], ["dry"]), ("s2", ["close"], ["Soon"], ["wet"]), ("s3", ["close"], ["Soon"], [])], "scenario string, actions array<string>, dispositions array<string>, keywords array<string>")
    assert {(r.scenario, r.passed, len(r.missing)) for r in domain.scenario_checks(got, want).collect()} == {("s1", True, 0), ("s2", False, 1), ("s3", False, 0)}


def test_a_case_runs_waits_and_resumes(spark, tmp_path):
    from larkfield.operators import runner
    from larkfield.sources.checkpoints import Checkpoints

    steps = {"screen": lambda s: {"perception_state": {"anomaly_screen": "odd"}}, "approval": lambda s: {"case_status": "approved"}, "execute": lambda s: {"final_decision": s["note"]}}
    after = {"screen": "approval", "approval": "execute", "execute": runner.END}
    held = Checkpoints(spark, str(tmp_path / "c"))
    run = runner.CaseRunner(steps, lambda n, s: after[n], held, waits=("approval",), settings={"dry_run": True})
    seen = []
    assert [n for n, _ in run.run("t1", "screen", runner.initial_state("S", "2024-01-01", note="n"), lambda n, s: seen.append(n))] == ["screen"] == seen
    assert held.exists("t1") and not held.exists("t2")
    other = runner.CaseRunner(steps, lambda n, s: after[n], held, settings={"dry_run": False})
    with pytest.raises(ValueError):
        list(other.resume("t1"))
    out = list(run.resume("t1", {"note": "changed"}))
    assert [n for n, _ in out] == ["approval", "execute"] and out[-1][1]["final_decision"] == "changed" and out[-1][1]["perception_state"] == {"perception_rounds": 0, "anomaly_screen": "odd"}
    assert not held.exists("t1")
    with pytest.raises(LookupError):
        list(run.resume("t1"))
    held.save("t3", "x", {}, "s")
    held.clear_all()
    assert held.rows().count() == 0
    with pytest.raises(RuntimeError):
        list(runner.CaseRunner({"a": lambda s: {}}, lambda n, s: "a", most=3).run("t", "a", {}))


def test_reports(spark, tmp_path):
    from larkfield.operators import reports
    from larkfield.operators.cases import STATE

    p, d = ("seen", "odd", "high", True, 1), ("", "", "", "", "", 0)
    rows = [("S/1", "", "2024-01-02", "", "", p, d, ("notes", "one\ntwo", "", "", "wo", "", "", "yes", True, "", 1, 1, 0), None, "do it", "executed"), ("S2", "", "2024-01-02", "", "", None, None, None, None, "", "running")]
    states = spark.createDataFrame(rows, STATE)
    got = {(r.case, r.path): r.text for r in reports.files(states).collect()}
    assert {path for case, path in got if case == "S2"} == {"complete_report.md"} and got[("S/1", "1_perception/report.md")] == "seen" and ("S/1", "2_diagnosis/report.md") not in got
    whole = got[("S/1", "complete_report.md")]
    assert whole.startswith("# 维护决策报告：S/1") and whole.index("## 维护决策单") < whole.index("## 一、感知") < whole.index("## 三、协调决策") and "二、诊断" not in whole
    parts = ["## 维护决策单\n\ndo it", "## 一、感知\n\n### 感知报告\nseen\n\n### 异常初筛\nodd", "## 三、协调决策\n\n### 中枢决策记录\none\ntwo\n\n### 维护工单\nwo\n\n### 审批\nyes"]
    assert whole == "# 维护决策报告：S/1\n\n基准日期：2024-01-02\n案件状态：executed\n" + "\n\n".join(parts) + "\n"
    assert got[("S2", "complete_report.md")] == "# 维护决策报告：S2\n\n基准日期：2024-01-02\n案件状态：running\n\n"
    assert got[("S/1", "3_coordination/decisions.md")] == "one\ntwo" and {p for c, p in got if c == "S/1" and p.startswith("3")} == {"3_coordination/decisions.md", "3_coordination/work_order.md"}
    ill = spark.createDataFrame([("S3", "", "d", "", "", None, ("", "high", None, "why", "", 0), None, None, "", "")], STATE)
    ill = {r.path: r.text for r in reports.files(ill).collect()}
    assert ill["2_diagnosis/severity.md"] == "严重度：high\n置信度：\n\nwhy" and "### 严重度与依据\n严重度：high；置信度：\n\nwhy" in ill["complete_report.md"] and "2_diagnosis/report.md" not in ill
    reports.write_tree(states, str(tmp_path / "r"))
    assert (tmp_path / "r" / "case=S_1" / "file=complete_report.md").is_dir()
    t = spark.createDataFrame([(None,), ([],), (["a", "b"],)], "r array<string>").select(reports.resources_text(F.col("r")).alias("t")).collect()
    assert [r.t for r in t] == ["资源未登记", "无可用资源", "a、b"]
    f = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "path string, length long, modificationTime string")
    assert reports.fingerprint(f).first() == reports.fingerprint(f.orderBy(F.desc("path"))).first() != reports.fingerprint(f.limit(1)).first()


def test_manuals(spark, tmp_path):
    from larkfield.sources import manuals

    texts = {"one": "\ufeff---\nname: One\n# no: field\n\nurl: http://x: y\nname: Two\n---\n\nBody --- here\n", "two": "no head", "three": "---\nname: open"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text, encoding="utf-8")
    got = {r.name: (r.meta, r.body) for r in manuals.read_manuals(spark, str(tmp_path)).collect()}
    assert got == {"one": ({"name": "Two", "url": "http://x: y"}, "Body --- here"), "two": ({}, "no head"), "three": ({}, "---\nname: open")}
    assert manuals.load_skill(manuals.read_manuals(spark, str(tmp_path)), " TWO ") == "no head"
    with pytest.raises(KeyError):
        manuals.load_skill(manuals.read_manuals(spark, str(tmp_path)), "four")



def test_crop_names_of_one_group(spark):
    from larkfield.runtime import Scratch

    labels = spark.createDataFrame([("crop:1", "Tomato"), ("crop:1", "番茄"), ("crop:2", "番茄"), ("crop:2", "西红柿"), ("crop:3", "Rice"), ("crop:3", "oryza"), ("card:9", "tomato"), ("card:9", "rice"), ("kg:crop:4", "corn"), ("crop:5", " ")], "term_id string, label string")
    groups = domain.crop_groups(labels, Scratch(spark, "crops"))
    held = {}
    for r in groups.collect():
        held.setdefault(r.group_id, set()).add(r.name)
    assert sorted(map(sorted, held.values())) == [["corn"], ["kharif paddy", "oryza", "paddy", "rice", "sali paddy", "水稻"], sorted(["tomato", "番茄", "西红柿"])]
    asked = spark.createDataFrame([(1, "d", "番茄"), (2, "d", "PADDY"), (3, "d", None), (4, "e", None), (5, "d", "wheat")], "query_id int, disease_id string, crop string").selectExpr("*", "cast(null as string) parent_id", "array(cast(null as string)) names")
    plans = spark.createDataFrame([("p1", "d", "西红柿"), ("p2", "d", "tomato"), ("p3", "d", "oryza"), ("p4", "e", "rice"), ("p5", "e", "水稻"), ("p6", "d", "Wheat")], "doc_id string, disease_id string, host string").selectExpr("*", "'treatment' kind", "cast(null as string) parent_id", "array(cast(null as string)) names")
    got = {}
    for r in domain.treatments(asked, plans, groups).collect():
        got.setdefault((r.query_id, r.refused), set()).add(r.doc_id)
    assert got == {(1, False): {"p1", "p2"}, (2, False): {"p3"}, (3, True): {"p1", "p2", "p3", "p6"}, (4, False): {"p4", "p5"}, (5, False): {"p6"}}
    rows = spark.createDataFrame([(1, ["番茄", "x"]), (2, []), (3, None), (4, ["西红柿", "TOMATO", None])], "doc_id int, crops array<string>")
    one = next(g for g, names in held.items() if "tomato" in names)
    assert {r.doc_id: None if r.crops is None else sorted(r.crops) for r in domain.crops_as_groups(rows, "doc_id", "crops", groups).collect()} == {1: sorted([one, "x"]), 2: [], 3: [], 4: [one]}


def test_diagnosis(spark):
    g = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, identity string, rank int")
    h = spark.createDataFrame([(1, "y", 1), (1, "y", 2), (1, "z", 3)], "query_id int, identity string, rank int")
    assert [(r.identity, r.best) for r in domain.diagnose(g, h).orderBy("rank").collect()] == [("y", 1), ("x", 1), ("z", 2)]


def test_states(spark):
    from larkfield.operators import cases

    full = ("s", "field", "2024-01-01", "", "", ("rep", "screen", "high", True, 1), ("", "", None, "", None, 1), ("n", "n", "close", "", "wo", None, "pass", "ok", None, "", 1, 0, 0), None, "f", "closed_no_action")
    df = spark.createDataFrame([full], cases.STATE)
    r = cases.respond(cases.project_state(df)).first()
    assert r.severity == "high" and r.description == "screen" and r.coordination.approved is False and r.execution.status == "" and r.perception.has_anomaly
    v = lambda a, n: tuple(spark.range(1).select(cases.close(F.lit(a), F.lit(n))).first()[0])
    assert v("close", "处置等级：尽快处置") == ("Soon", False) and v("", "nothing here") == ("Monitor", False) and v("plan_work_order", "处置等级：尽快处置") == ("REVIEW", True)
    ev = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "awaiting_approval"), ("a", 4, "completed"), ("b", 1, "running")], "case_id string, seq int, status string")
    assert {(x.case_id, x.seq) for x in cases.bad_transitions(ev).collect()} == {("a", 4), ("b", 1)}
    ok = lambda *x: spark.range(1).select(cases.valid_request(*map(F.lit, x))).first()[0]
    assert ok("F-1", "2024-01-01", "", True) and not ok("../x", "2024-01-01", "", True) and not ok("F", "2024-1-1", "", True) and not ok("F", "2024-01-01", "", False)


def test_settings():
    from larkfield import config

    c = config.with_environment(config.DEFAULTS, {"LARKFIELD_TOP_K": "7", "LARKFIELD_DRY_RUN": "no", "LARKFIELD_MIN_DENSE": "0.2", "LARKFIELD_AUTO_CLOSE": ""})
    assert (c["top_k"], c["dry_run"], c["min_dense"], c["auto_close"]) == (7, False, 0.2, True)
    with pytest.raises(ValueError):
        config.with_environment(config.DEFAULTS, {"LARKFIELD_DRY_RUN": "maybe"})
    assert config.merged({"a": {"x": 1}, "b": 2}, {"a": {"y": 2}, "b": None}) == {"a": {"x": 1, "y": 2}, "b": 2}
    assert config.split_paths("a: b:a") == ["a", "b"]


def test_vendors(spark):
    from larkfield import config
    from larkfield.sources import vendors
    from larkfield.sources.errors import NoDataError

    assert vendors.call("get_device_status", config.DEFAULTS, spark, "s", "2024-01-01").count() == 4
    assert vendors.call("get_resource_inventory", config.DEFAULTS, spark, "s").where("item = '叶面肥 Y' AND amount = 0.5").count() == 1
    with pytest.raises(NoDataError):
        vendors.call("check_safety_policy", config.DEFAULTS, "a", "b")
    gone = config.merged(config.DEFAULTS, {"tools": {"get_camera_snapshot": "placeholder"}})
    assert vendors.call("get_camera_snapshot", gone, spark, "s", "2024-01-01") is None
    assert vendors.call("get_camera_snapshot", config.DEFAULTS, spark, "s", "2024-01-01").count() == 1
