from pyspark.sql import functions as F

from fixtures import DASHBOARD, SIEM_ALERTS, write_lines
from sievewatch.operators import dashboard, normalise as nz, triage
from sievewatch.sources import alerts as src


def raw(spark, tmp_path, alerts=SIEM_ALERTS):
    return src.read_alerts(spark, write_lines(tmp_path / "alerts.json", alerts))


def flat(spark, tmp_path):
    n = nz.flat(nz.normalise(raw(spark, tmp_path)))
    return n.withColumn("attempts", F.lit(None).cast("string"))


def test_forward_and_category(spark, tmp_path):
    df = raw(spark, tmp_path)
    kept = {r.id for r in nz.forward(df).collect()}
    assert kept == {"7301", "7304", "7305"}
    got = {r.alert_id: r.category for r in nz.normalise(df).collect()}
    assert [got[a["id"]] for a in SIEM_ALERTS] == [
        "brute_force", "other", "malware", "brute_force", "other",
    ]


def test_category_by_words(spark):
    rows = [
        (["web"], "Brute attempt"), ([], "a hidden file"), ([], "Support report"), (None, None),
        (["SSHD"], "x"), (["Sudo"], "brute"),
    ]
    df = spark.createDataFrame(rows, "g ARRAY<STRING>, d STRING")
    assert [r[0] for r in df.select(nz.infer_category("g", "d")).collect()] == [
        "brute_force", "malware", "reconnaissance", "other", "brute_force", "privilege_escalation",
    ]


def test_missing_value_rules(spark, tmp_path):
    base = {"timestamp": "2024-01-01T00:00:00Z", "agent": {"ip": "1.1.1.1"}}
    alerts = [
        {**base, "id": "a", "data": {"md5": None, "sha256": "s", "srcip": "", "src_ip": "2.2.2.2"}},
        {**base, "id": "b", "data": {"sha256": "s", "dstip": "", "dstuser": "", "user": "u"},
         "rule": {"level": "x"}},
        {**base, "id": "c", "full_log": None, "message": "m" * 600, "rule": {"level": "7", "id": 9}},
        {**base, "rule": {"mitre": {"id": [], "technique": []}}},
    ]
    n = nz.normalise(raw(spark, tmp_path, alerts))
    got = {r.alert_id: r for r in n.collect()}
    assert got["a"].indicators.file_hash is None and got["a"].indicators.src_ip == "2.2.2.2"
    b = got["b"].indicators
    assert (b.file_hash, b.dst_ip, b.username) == ("s", "1.1.1.1", "u")
    assert len(got["c"].raw_log) == 500 and got["c"].rule.id == "9" and got["c"].rule.level == 7
    made = [k for k in got if k not in "abc"]
    assert len(made) == 1 and made[0].startswith("alert-")
    assert made == [r.alert_id for r in nz.normalise(raw(spark, tmp_path, alerts)).collect()
                    if r.alert_id not in "abc"]
    assert got[made[0]].source.agent_name == "unknown" and got[made[0]].rule.level == 0
    assert [r.alert_id for r in nz.rejected_alerts(n).collect()] == ["b"]


def test_validation(spark, tmp_path):
    good = {
        "alert_id": "x", "timestamp": "t", "source": {"agent_name": "n", "agent_ip": "i"},
        "rule": {"id": "1", "description": "d", "level": 10}, "category": "brute_force",
        "raw_log": "", "indicators": {"src_port": 22}, "mitre_hint": {},
    }
    path = write_lines(tmp_path / "posted.json", [good, {"alert_id": "y"}])
    rows = nz.read_normalised(spark, path)
    valid = nz.valid_alerts(rows).collect()
    assert [(r.alert_id, r.status, r.rule.level) for r in valid] == [("x", "new", 10)]
    bad = nz.rejected_alerts(rows).collect()
    assert [r.alert_id for r in bad] == ["y"] and len(bad[0].errors) == 10


def test_lines_and_rejects(spark, tmp_path):
    path = tmp_path / "mixed.log"
    path.write_text('{"id": "1"}\n\n   \n  {"id": "2"}  \n{"id": "3"\nplain text\n', encoding="utf-8")
    assert {r.id for r in src.read_alerts(spark, str(path)).collect()} == {"1", "2"}
    parsed = src.parse_lines(src.read_lines(spark, str(path)))
    assert {r.id for r in src.alerts_of(parsed).collect()} == {"1", "2"}
    assert {r.line for r in src.rejected_lines(parsed).collect()} == {'{"id": "3"', "plain text"}


def test_requests(spark, tmp_path):
    alerts = flat(spark, tmp_path)
    asked = [("c", "critical alerts"), ("h", "HIGH severity"), ("i", "alert 7303"),
             ("n", "alert 999"), ("p", "show high priority")]
    reqs = spark.createDataFrame(asked, "request_id STRING, text STRING")
    got = {r.request_id: r for r in triage.route_requests(reqs, alerts).collect()}
    assert (got["c"].n_matches, got["h"].n_matches, got["n"].n_matches) == (2, 3, 5)
    assert got["i"].alert_id == "7303" and got["i"].route == "id"
    assert got["p"].label == "CRITICAL (level 10+)"
    ids = {r.alert_id for r in triage.route_alerts(alerts, got["h"].label).collect()}
    assert ids == {"7301", "7303", "7305"}
    none = triage.route_requests(reqs, alerts.where("rule_level > 99"))
    assert "No recent alerts found in SIEM." in {r.header for r in none.collect()}


def test_requests_search_their_text_once(spark, tmp_path):
    asked = [("a", "alert 12 171x9 13"), ("b", "alert 171x9"), ("c", "12"), ("d", "ALERT\t7\n"), ("e", None), ("f", "alert 12a 3b"), ("g", "alert 171")]
    reqs = spark.createDataFrame(asked, "request_id STRING, text STRING")
    got = {r.request_id: r.id_words for r in triage.parse_requests(reqs).collect()}
    assert got == {"a": ["12", "171x9", "13"], "b": [], "c": [], "d": ["7"], "e": [], "f": [], "g": ["171"]}
    alerts = spark.createDataFrame([("12", 3)], "alert_id STRING, rule_level INT")
    routed = triage.route_requests(reqs, alerts)._jdf.queryExecution().optimizedPlan()
    assert routed.toString().count("regexp_extract_all") == 2  # for the ids that are asked for, and for the words of a request


def test_summary_line(spark, tmp_path):
    df = raw(spark, tmp_path)
    n = nz.flat(nz.normalise(df)).join(
        nz.with_data(df).select(F.col("id").alias("alert_id"),
                                F.col("data.attempt_count").alias("attempts"),
                                F.col("data.srcip").alias("given_ip")), "alert_id")
    got = {r[0]: r[1] for r in n.select("alert_id", triage.summary_line(src_ip="given_ip")).collect()}
    assert got["7301"] == (
        "[Alert 7301] Level 11/15 | Repeated SSH logins refused | Host: edge-gw (172.20.4.10)"
        " | Source IP: 192.0.2.77, 56 attempts | Time: 2025-03-04T08:15:30.000Z"
    )
    assert "Source IP: N/A | Time" in got["7302"]


def test_dashboard(spark):
    df = spark.createDataFrame(DASHBOARD, "rule_level INT, rule_groups ARRAY<STRING>")
    strip = dashboard.severity_strip(df).first()
    assert (strip.total, strip.critical, strip.high, strip.medium, strip.low) == (8, 2, 2, 2, 2)
    k = dashboard.kpis(df).first()
    assert (k.total, k.critical, k.mean_level, k.mean_level_text) == (8, 2, 7.25, "7.3")
    tags = [(r.name, r["count"]) for r in dashboard.tag_counts(df).collect()]
    assert tags[:2] == [("Host", 2), ("Worm", 2)] and len(tags) == 8
    empty = dashboard.kpis(df.where("rule_level > 99")).first()
    assert (empty.total, empty.mean_level, empty.mean_level_text) == (0, 0.0, "0")


def test_queue(spark, tmp_path):
    alerts = flat(spark, tmp_path)
    assert [r.alert_id for r in triage.queue_order(alerts).collect()][0] == "7303"
    assert triage.queue_view(alerts, "HIGH", "EDGE-gw").count() == 1
    assert triage.queue_view(alerts, search="172.20.4.31").count() == 2
    assert [r.alert_id for r in triage.most_recent(alerts, 2).collect()] == [
        "7305", "7304",
    ]
    assert triage.in_window(alerts, "2025-03-04 09:00:00", "2025-03-04 11:00:00").count() == 2
    assert triage.by_id(alerts.unionByName(alerts), "7301").count() == 1


def test_level_bars(spark):
    df = spark.createDataFrame(
        [("1", "A description of 25 chars", 9), ("2", None, 1)],
        "alert_id STRING, description STRING, rule_level INT",
    )
    got = [(r.name, r.fill) for r in dashboard.level_bars(df).orderBy("alert_id").collect()]
    assert got == [("A description of 2…", "#ed8936"), ("Unknown", "#38a169")]


def test_rows_do_not_depend_on_columns(spark, tmp_path):
    """Fields of another kind never lose a line, whatever is asked for."""
    odd = [
        {"id": "1", "rule": {"id": 5, "level": 10.0, "groups": "text", "mitre": "T1"}, "agent": {"name": "a"}},
        {"id": "2", "rule": "text", "agent": "text", "data": "text"},
        {"id": "3", "rule": {"level": "9.7", "groups": ["sshd"]}, "agent": {"name": ["x"]}, "more": {"a": 1}},
        {"id": 4}, {"rule": {"level": 6}},
    ]
    path = write_lines(tmp_path / "odd.json", odd)
    with open(path, "a", encoding="utf-8") as f:
        f.write("broken {\n\n")
    rows = src.read_alerts(spark, path)
    assert rows.count() == rows.select("id").count() == len(rows.collect()) == nz.normalise(rows).count() == 5
    got = {r.alert_id: r for r in nz.normalise(rows).collect()}
    assert got["1"].rule.level == 10 and got["1"].source.agent_name == "a" and got["3"].rule.level == 9
    assert got["3"].category == "brute_force" and got["2"].rule.id == "0"
    assert sorted(r.alert_id[:5] for r in nz.normalise(nz.forward(rows)).collect()) == ["1", "3", "alert"]
    parsed = src.parse_lines(src.read_lines(spark, path))
    assert src.alerts_of(parsed).count() == 5 and src.rejected_lines(parsed).count() == 1


def test_wrong_types_are_rejected(spark, tmp_path):
    good = {
        "alert_id": "x", "timestamp": "t", "source": {"agent_name": "n", "agent_ip": "i"},
        "rule": {"id": "1", "description": "d", "level": 10}, "category": "c", "raw_log": "",
        "indicators": {"src_port": 22}, "mitre_hint": {},
    }
    rows = [good, {**good, "alert_id": "port", "indicators": {"src_port": "abc"}}, {**good, "alert_id": "rule", "rule": "text"},
            {**good, "alert_id": "level", "rule": {**good["rule"], "level": "high"}}]
    read = nz.read_normalised(spark, write_lines(tmp_path / "posted.json", rows))
    assert read.count() == 4 and [r.alert_id for r in nz.valid_alerts(read).collect()] == ["x"]
    bad = {r.alert_id: set(r.errors) for r in nz.rejected_alerts(read).collect()}
    assert bad["port"] == {"indicators.src_port"} and bad["level"] == {"rule.level"}
    assert bad["rule"] == {"rule", "rule.id", "rule.description", "rule.level"}
    assert nz.valid_alerts(read).first().indicators.src_port == 22
