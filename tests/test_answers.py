import json

from pyspark.sql import functions as F

from sievewatch.operators import answers as an, prompts as pr, reports as rp, retrieval as rv
from fixtures import TECHNIQUES

ANSWER = (
    "SEVERITY: CRITICAL\n\nMITRE TECHNIQUES IDENTIFIED:\n- T1110 Brute Force\n\nREASONING:\n"
    "- many failures\n- see MITRE T1110\n\nRECOMMENDED ACTION:\nBlock the source."
)


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "text STRING").select(*cols).first()


def test_three_patterns(spark):
    df = spark.createDataFrame([("a", ANSWER), ("b", "no rating"), ("c", None)], "id STRING, text STRING")
    got = {r.id: r for r in an.parse_answers(df).collect()}
    assert got["a"].severity == "CRITICAL"
    # the patterns cut reasoning at the first MITRE and keep IDENTIFIED: in the technique
    assert got["a"].reasoning == "• many failures\n• see"
    assert got["a"].technique.startswith("IDENTIFIED:\n- T1110 Brute Force\n\nREASONING:")
    assert got["b"].severity is None and got["b"].reasoning == "" and got["b"].technique is None


def test_object_fields_are_the_fallback(spark):
    df = spark.createDataFrame(
        [("x", "LOW", "r", "T1")], "text STRING, severity STRING, result STRING, mitre_technique STRING")
    r = an.parse_answers(df).first()
    assert (r.severity, r.reasoning, r.technique) == ("LOW", "r", "T1")


def test_endpoint_object_text(spark):
    r = one(spark, ANSWER, an.endpoint_json("text").alias("t"))
    assert json.loads(r.t) == {"success": True, "classification": ANSWER}
    df = spark.createDataFrame([(ANSWER,)], "text STRING").select(an.endpoint_json("text").alias("text"))
    assert an.parse_answers(df).first().severity == "CRITICAL"


def test_sections(spark):
    r = an.parse_sections(spark.createDataFrame([(ANSWER,)], "text STRING")).first()
    assert r.techniques == ["T1110 Brute Force"] and r.reasons == ["many failures", "see MITRE T1110"]
    assert r.action == "Block the source." and r.primary_id is None
    m = an.parse_sections(spark.createDataFrame([(
        "PRIMARY TECHNIQUE: T1110.001 - Password Guessing\nCONFIDENCE: High\nREASON: fits\n"
        "SECONDARY TECHNIQUE (if applicable): T1021 - Remote",)], "text STRING")).first()
    assert (m.primary_id, m.primary_name, m.confidence, m.reason, m.secondary) == (
        "T1110.001", "Password Guessing", "High", "fits", "T1021 - Remote")


def test_clean_text_and_severity(spark):
    assert one(spark, "a\\n- b\n  • c\n", an.clean_text("text"))[0] == "a\n• b\n• c"
    assert one(spark, "x\nseverity: high or critical\nSEVERITY: LOW", an.text_severity("text"))[0] == "CRITICAL"
    assert one(spark, None, an.text_severity("text"))[0] == "UNKNOWN"


def steps(spark, replies, alert="A"):
    return spark.createDataFrame(
        [("i", alert, n, r, f"obs{n} " + "o" * 700) for n, r in enumerate(replies, start=1)],
        "investigation STRING, alert STRING, step INT, reply STRING, observation STRING")


def reply(tool, value):
    return f"Thought: think\nAction: {tool}\nAction Input: {value}"


def test_actions_and_usage(spark):
    df = steps(spark, [reply("query_siem", '"1717"'), reply("Check_CVE", "'x'\n\nObservation: y"),
                       "rubbish", reply("rm_all", "z")])
    got = an.step_parts(df).orderBy("step").collect()
    assert [r.action for r in got] == ["query_siem", "Check_CVE", None, "rm_all"]
    assert [r.action_input for r in got] == ["1717", "x", None, "z"]
    use = {(r.tool, r.status): r.n for r in an.tool_usage(df).collect()}
    assert use == {("query_siem", "known"): 1, ("check_cve", "known"): 1, (None, "unreadable"): 1,
                   ("rm_all", "unknown"): 1}


def test_investigation_log(spark):
    df = steps(spark, [reply("query_siem", "1"), "rubbish", reply("generate_report", "all"),
                       reply("check_cve", "late")])
    r = pr.investigation_logs(df).first()
    block = ("\nStep 1:\nThought: think\nAction: query_siem\nAction Input: 1\nObservation: obs1 "
             + "o" * 595 + "\n")
    log = block + "\nStep 2: LLM response unclear, continuing...\n"
    assert r.log == log and r.tools_used == "query_siem" and r.report_step == 3
    assert r.findings == (
        f"Alert: A\n\nReal findings from investigation:\n{log}\n\nTools used: query_siem\n")
    forced = pr.investigation_logs(steps(spark, [reply("query_siem", "1")] * 9)).first()
    assert forced.log.count("Step ") == 7 and forced.findings.startswith("Alert: A\n\nFindings:\n")


def test_classify_prompt(spark):
    alert = {"alert_id": "é", "rule": {"id": "1", "level": 3}, "groups": ["a"]}
    df = spark.createDataFrame([("k", alert)],
                               "alert_id STRING, alert STRUCT<alert_id: STRING, rule: STRUCT<id: "
                               "STRING, level: INT>, groups: ARRAY<STRING>>")
    prompt = pr.classify_prompts(df).first().prompt
    assert prompt == pr.CLASSIFY_PROMPT.replace("{alert_json}", json.dumps(alert, indent=2))
    context = spark.createDataFrame([("k", "[T1] {alert_json}")], "alert_id STRING, mitre_context STRING")
    both = pr.context_prompts(df, context).first().prompt
    assert "--- MITRE ATT&CK CONTEXT ---\n[T1] {alert_json}\n--- END CONTEXT ---" in both


def test_shared_contexts_travel_once(spark):
    alerts = spark.createDataFrame([(f"k{i}", (i,)) for i in range(6)] + [("k0", (9,))], "alert_id STRING, alert STRUCT<n: INT>")
    context = spark.createDataFrame(
        [("k0", "one"), ("k0", "one"), ("k1", "one"), ("k2", "two"), ("k3", None), ("k4", "")], "alert_id STRING, mitre_context STRING")
    prompts = pr.context_prompts(alerts, context)
    assert "first(mitre_context" not in prompts._jdf.queryExecution().optimizedPlan().toString()  # no long text per alert
    got = sorted((r.alert_id, r.prompt.split("CONTEXT ---\n")[1].split("\n--- END")[0]) for r in prompts.collect())
    assert got == [("k0", "one"), ("k0", "one"), ("k1", "one"), ("k2", "two"), ("k3", ""), ("k4", "")]


def test_findings_text(spark):
    alert, label = {"id": "x'y", "level": 3}, {"severity": "LOW"}
    df = spark.createDataFrame([(alert, label), (alert, None)],
                               "alert STRUCT<id: STRING, level: INT>, classification STRUCT<severity: STRING>")
    got = [r[0] for r in df.select(pr.findings(df)).collect()]
    assert got == [f"Alert: {alert}\nClassification: {label}", f"Alert: {alert}\nClassification: {{}}"]


def test_saved_classification(spark):
    df = spark.createDataFrame(
        [("1", None, None, ["a", "b"]), ("2", "HIGH", "r", None)],
        "alert_id STRING, severity STRING, reasoning STRING, mitre_tactics ARRAY<STRING>")
    got = {tuple(r) for r in an.saved_classification(df).collect()}
    assert got == {("1", "UNKNOWN", "", "a, b"), ("2", "HIGH", "r", "")}


def test_reports(spark):
    df = spark.createDataFrame(
        [("1", "t", "web", "1.2.3.4", "5712", 10, "SSH", None, "HIGH")],
        "alert_id STRING, timestamp STRING, agent_name STRING, agent_ip STRING, rule_id STRING, "
        "rule_level INT, description STRING, technique STRING, severity STRING")
    s = rp.incident_summary(df).first()
    assert (s.affected_host, s.rule_level, s.detection_source) == (
        "web (1.2.3.4)", "10 / 15", "SIEM — Rule 5712")
    events = [r.event for r in rp.incident_timeline(df).orderBy("step").collect()]
    assert events[1] == "MITRE ATT&CK technique mapped: Under analysis" and len(events) == 3
    acts = rp.recommended_actions(df).orderBy("step").collect()
    assert acts[0].action.startswith("Isolate web and") and "identified attack technique" in acts[2].action
    assert rp.section_items(df).count() == 19
    text = df.select(rp.basic_report(F.lit("found"), F.lit("2024"))).first()[0]
    assert "Generated: 2024\n" in text and "FINDINGS SUMMARY:\nfound\n" in text


def technique_table(spark):
    docs = spark.createDataFrame(TECHNIQUES, "id STRING, name STRING, text STRING")
    docs = docs.withColumn("source", F.lit(rv.TECHNIQUES))
    model = rv.fit_text_vectors(docs)
    return model, rv.text_vectors(model, docs)


def test_text_search_and_context(spark):
    model, docs = technique_table(spark)
    asked = spark.createDataFrame(
        [("1", "many SSH logins guessing passwords"), ("2", "drivers hide files")],
        "query_id STRING, text STRING")
    queries = rv.text_vectors(model, asked).withColumn("query", F.col("text")).drop("text")
    hits = rv.search(queries, docs, 3)
    best = {r.query_id: r.id for r in hits.where("rank = 1").collect()}
    assert best == {"1": "T1110", "2": "T1014"}
    checked = rv.retrieval_check(
        queries.withColumn("expected", F.when(F.col("query_id") == "1", "T1110").otherwise("T9")),
        hits, "expected", "id")
    total = rv.check_totals(checked).first()
    assert (total.passed, total.failed, total.mean_reciprocal_rank) == (1, 1, 0.5)
    none = spark.createDataFrame([("9", "q")], "query_id STRING, query STRING")
    every = queries.select("query_id", "query").unionByName(none)
    ctx = {r.query_id: r.context for r in rv.context_blocks(every, hits).collect()}
    assert ctx["9"] == rv.NO_CONTEXT
    assert ctx["1"].startswith("RELEVANT THREAT INTELLIGENCE CONTEXT:\n" + "=" * 50 +
                               "\n\n[1] Source: MITRE ATT&CK | ID: T1110 | Brute Force\n    Relevance score: ")
    assert "    Tactics: N/A\n    Platforms: N/A\n    Known threat groups: none\n" in ctx["1"]
    listed = {r.query_id: r.answer for r in rv.technique_lists(every, hits).collect()}
    assert listed["9"] == rv.NO_TECHNIQUES
    assert listed["2"].startswith("Top MITRE ATT&CK techniques matching 'drivers hide files':\n\n"
                                  "1. [T1014] Rootkit\n   Drivers that hide files")
    assert rv.search(queries, docs, 99).count() == 10


def test_exact_and_empty(spark):
    _, docs = technique_table(spark)
    asked = spark.createDataFrame([("a", "T1091"), ("b", "T0")], "query_id STRING, technique_id STRING")
    got = {r.query_id: (r.name, r.distance) for r in rv.techniques_by_id(asked, docs).collect()}
    assert got == {"a": ("Removable Media", 0.0), "b": (None, None)}
    try:
        rv.require_filled(docs.where("1 = 0"), "techniques")
        raise AssertionError("an empty collection must be refused")
    except ValueError:
        pass


def test_own_embedding_function(spark):
    def model(texts):
        return texts.map(lambda x: [float(len(x)), 1.0])

    got = rv.embed_with(spark.createDataFrame([("abc",)], "text STRING"), model).first().embedding
    assert got == [3.0, 1.0]
