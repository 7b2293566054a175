import json
import pathlib

from pyspark.sql import functions as F

from sievewatch.operators import dashboard, techniques as tq, vulnerabilities as vu
from sievewatch.sources import feeds

BUNDLE = {"type": "bundle", "id": "bundle--1", "objects": [
    {"type": "attack-pattern", "id": "ap--1", "name": "Brute Force",
     "description": "See [Valid Accounts](https://example.org/x) " + "d" * 2000,
     "external_references": [{"source_name": "other", "external_id": "O"},
                             {"source_name": "mitre-attack", "external_id": "T1110"}],
     "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "credential-access"}],
     "x_mitre_platforms": ["Linux", "Windows"], "x_mitre_detection": "Watch logs"},
    {"type": "attack-pattern", "id": "ap--2", "name": "Old", "revoked": True,
     "external_references": [{"source_name": "mitre-attack", "external_id": "T9"}]},
    {"type": "attack-pattern", "id": "ap--3", "name": "No id"},
    {"type": "intrusion-set", "id": "is--1", "name": "Group A"},
    {"type": "intrusion-set", "id": "is--2", "name": "Group B"},
    {"type": "relationship", "id": "r--1", "relationship_type": "uses",
     "source_ref": "is--2", "target_ref": "ap--1"},
    {"type": "relationship", "id": "r--2", "relationship_type": "uses",
     "source_ref": "is--1", "target_ref": "ap--1"},
    {"type": "relationship", "id": "r--3", "relationship_type": "mitigates",
     "source_ref": "is--1", "target_ref": "ap--1"},
    {"type": "intrusion-set", "id": "is--1", "name": "Group A renamed"},
]}


def objects(spark, tmp_path):
    (tmp_path / "bundle.json").write_text(json.dumps(BUNDLE, indent=1), encoding="utf-8")
    return feeds.read_stix_bundle(spark, str(tmp_path / "bundle.json"))


def test_bundle(spark, tmp_path):
    objs = objects(spark, tmp_path)
    assert objs.count() == 9
    assert {r.id for r in tq.active_techniques(objs).collect()} == {"ap--1", "ap--3"}
    edges = [(r.stix_id, r.group_name) for r in tq.group_edges(objs).orderBy("pos").collect()]
    assert edges == [("ap--1", "Group B"), ("ap--1", "Group A renamed")]
    assert tq.group_count(tq.group_edges(objs)).first()[0] == 2
    row = tq.technique_rows(objs).collect()
    assert len(row) == 1 and row[0].threat_groups == "Group B, Group A renamed"
    assert row[0].tactics == "Credential Access" and row[0].detection == ""
    assert row[0].text.startswith(
        "MITRE ATT&CK Technique: T1110 — Brute Force\n\nTactics: Credential Access\n"
        "Platforms: Linux, Windows\n\nDescription:\nSee Valid Accounts ddd"
    )
    assert row[0].text.endswith("Detection Data Sources: Not specified")
    assert row[0].text.count("d" * 1481) == 1 and "d" * 1482 not in row[0].text
    plain = tq.plain_techniques(objs).first()
    assert plain.text.endswith("Detection: Watch logs\n") and "[Valid Accounts]" in plain.text
    assert [r.technique_id for r in tq.first_techniques(objs).collect()] == ["T1110", "T9", "N/A"]


def test_bundle_is_cached(spark, tmp_path):
    objects(spark, tmp_path)
    cache = str(tmp_path / "cache")
    read = lambda: feeds.cached_feed(
        spark, str(tmp_path / "bundle.json"), cache, feeds.read_stix_bundle
    ).count()
    assert read() == 9
    (tmp_path / "bundle.json").write_text('{"objects": []}', encoding="utf-8")
    assert read() == 9


def cve(**kw):
    return {"cve": {"id": "CVE-2021-1", "published": "2021-02-03T00:00:00", **kw}}


M31 = [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]
M2 = [{"cvssData": {"baseScore": 5.0}, "baseSeverity": "MEDIUM"}]


def items(spark, tmp_path, entries):
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": entries}), encoding="utf-8")
    return feeds.read_cve_feed(spark, str(tmp_path / "nvd.json"))


def test_cve_feed(spark, tmp_path):
    cpe = lambda *names: {"cpeMatch": [{"criteria": n} for n in names]}
    config = {"nodes": [
        cpe("cpe:2.3:a:v:p:1", "cpe:2.3:a:*:p:1", "cpe:2.3:a:v:p:2", "cpe:2.3:a:cut:off:1"),
        cpe("short"), cpe("cpe:2.3:a:w:q:1"),
    ]}
    df = items(spark, tmp_path, [
        cve(descriptions=[{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}],
            metrics={"cvssMetricV31": M31, "cvssMetricV2": M2}, configurations=[config],
            weaknesses=[{"description": [{"lang": "en", "value": "CWE-1"},
                                         {"lang": "es", "value": "x"}]}]),
        {"cve": {"id": ""}}, {"cve": {}},
        {"cve": {"id": "CVE-2021-2", "metrics": {"cvssMetricV31": [], "cvssMetricV2": M2}}},
        {"cve": {"id": "CVE-2021-3"}},
    ])
    got = {r.id: r for r in vu.with_facts(df).collect()}
    assert len(got) == 3
    one = got["CVE-2021-1"]
    assert (one.description, one.severity, one.cvss_score) == ("hello", "CRITICAL", 9.8)
    assert one.weaknesses == ["CWE-1"] and one.products == ["v p", "w q"]
    assert (got["CVE-2021-2"].severity, got["CVE-2021-2"].cvss_score) == ("MEDIUM", 5.0)
    assert (got["CVE-2021-3"].severity, got["CVE-2021-3"].cvss_score) == ("UNKNOWN", 0.0)
    text = {r.id: r.text for r in vu.cve_rows(df).collect()}
    assert text["CVE-2021-3"] == (
        "CVE: CVE-2021-3\nSeverity: UNKNOWN (CVSS Score: 0.0)\nPublished: Unknown\n\nDescription:\n"
        "No description available\n\nWeakness Type: Not specified\nAffected Products: Not specified"
    )
    listed = [(r.id, r.severity) for r in vu.first_cves(df, 2).collect()]
    assert listed == [("CVE-2021-1", "CRITICAL"), ("CVE-2021-2", "MEDIUM")]


def test_cve_lookup(spark, tmp_path):
    df = items(spark, tmp_path, [cve(metrics={"cvssMetricV2": M2})])
    asked = spark.createDataFrame(
        [(1, " cve-2021-44228 "), (2, "CVE-2021-1"), (3, "CVE-1999-9")], "request_id INT, cve_id STRING"
    )
    got = {r.request_id: r for r in vu.lookup_cves(asked, df).collect()}
    assert [got[i].status for i in (1, 2, 3)] == ["cache", "feed", "not found"]
    assert got[1].cvss_score == 10.0 and "10.0/10 — CRITICAL" in got[1].answer
    assert got[2].answer.startswith("CVE: CVE-2021-1\nPublished: 2021-02-03\nCVSS Score: 5.0/10")
    assert got[3].answer == "CVE lookup failed: CVE CVE-1999-9 not found in NVD database"


def test_flows(spark, tmp_path):
    (tmp_path / "flows.csv").write_bytes(
        b"Src IP, Label ,Flow Duration,Dst Port,Extra\n1.1.1.1, Benign ,10,80,x\n"
        b"2.2.2.2,Bot\xff,bad,22,y\n3.3.3.3,Benign,30,443,z\n"
    )
    flows = feeds.read_flows(spark, str(tmp_path / "flows.csv"))
    rows = feeds.first_flows(flows).collect()
    assert [r.label for r in rows] == ["Benign", "Bot", "Benign"]
    assert feeds.flow_view(flows.drop("Label")).first().label == "N/A"
    got = {r.label: (r.n, r.mean_duration)
           for r in dashboard.flow_labels(feeds.flow_view(flows)).collect()}
    assert got == {"Benign": (2, 20.0), "Bot": (1, None)}


def test_no_python_in_group_edges(spark, tmp_path, capsys):
    tq.group_edges(objects(spark, tmp_path)).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_group(spark):
    """One group with many techniques and one technique with many groups."""
    ap = spark.range(200).select(
        F.col("id").alias("pos"), F.concat(F.lit("ap-"), F.col("id")).alias("id"),
        F.lit("attack-pattern").alias("type"), F.lit("t").alias("name"))
    gr = spark.range(50).select(
        (F.col("id") + 1000).alias("pos"), F.concat(F.lit("is-"), F.col("id")).alias("id"),
        F.lit("intrusion-set").alias("type"), F.concat(F.lit("G"), F.col("id")).alias("name"))
    pairs = ([(f"is-{g}", "ap-0") for g in range(50)] + [("is-0", f"ap-{a}") for a in range(1, 200)])
    rel = spark.createDataFrame(
        [(2000 + i, f"r-{i}", "relationship", None, "uses", s, t) for i, (s, t) in enumerate(pairs)],
        "pos LONG, id STRING, type STRING, name STRING, relationship_type STRING, source_ref STRING, "
        "target_ref STRING",
    )
    objs = rel.unionByName(ap, allowMissingColumns=True).unionByName(gr, allowMissingColumns=True)
    edges = tq.group_edges(objs)
    assert edges.count() == 249
    top = {r.stix_id: r.threat_groups for r in tq.first_groups(edges).collect()}
    assert top["ap-0"] == ", ".join(f"G{i}" for i in range(10)) and top["ap-7"] == "G0"


def test_several_documents(spark, tmp_path):
    """Positions restart per document; document order decides across them."""
    folder = tmp_path / "bundles"
    folder.mkdir()
    for name, title in (("a.json", "Old name"), ("b.json", "New name")):
        (folder / name).write_text(json.dumps({"type": "bundle", "id": name, "objects": [
            {"type": "intrusion-set", "id": "is--1", "name": title},
            {"type": "attack-pattern", "id": "ap--1", "name": "T"},
            {"type": "intrusion-set", "id": f"is--{name}", "name": f"Group of {name}"},
            {"type": "relationship", "id": f"r--{name}", "relationship_type": "uses", "source_ref": f"is--{name}",
             "target_ref": "ap--1"},
        ]}, indent=1), encoding="utf-8")
    objs = feeds.read_stix_bundle(spark, str(folder))
    assert objs.count() == 8 and {r.doc.rpartition("/")[2] for r in objs.collect()} == {"a.json", "b.json"}
    ordered = feeds.in_document_order(objs)
    assert {r.id: r.name for r in tq.object_index(ordered).collect()}["is--1"] == "New name"
    first = tq.first_groups(tq.group_edges(ordered)).first()
    assert first.threat_groups == "Group of a.json, Group of b.json"


def test_half_written_cache_is_replaced(spark, tmp_path):
    objects(spark, tmp_path)
    cache = tmp_path / "cache"
    spark.range(3).write.parquet(str(cache))
    (cache / "_SUCCESS").unlink()
    got = feeds.cached_feed(spark, str(tmp_path / "bundle.json"), str(cache), feeds.read_stix_bundle)
    assert got.count() == 9


def test_landed_inputs_are_packed_in_bounded_files(spark, tmp_path, monkeypatch):
    """The text of a graph repeats itself, and a packed file is read by one task."""
    import gzip

    from sievewatch.workloads import inputs

    rows = [(i, i % 5 + 1, f"part {i}") for i in range(10)]
    spark.createDataFrame(rows, "p_partkey BIGINT, p_size INT, p_name STRING").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(inputs, "LANDED_ROWS", 4)
    table = inputs.Tables(spark, str(tmp_path))
    files = sorted(p for p in pathlib.Path(table.landed("stix_bundles").removeprefix("file:")).iterdir() if p.name.startswith("part-"))
    lines = [gzip.open(p, "rt", encoding="utf-8").read().splitlines() for p in files]
    assert len(files) == 3 and max(map(len, lines)) == 4
    assert sorted(x for part in lines for x in part) == sorted(r.value for r in table.stix_bundles.collect())


def test_products_of_a_feed_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A packed feed looks small on disk and names many products: only the counted inventory may be broadcast."""
    from sievewatch.plans import joins

    rows = [(f"CVE-{i}", "HIGH", 7.5, [f"v p{j}" for j in range(40)] + [f"v own{i}"]) for i in range(50)]
    spark.createDataFrame(rows, "id STRING, severity STRING, cvss_score DOUBLE, products ARRAY<STRING>").write.parquet(str(tmp_path / "cves"))
    cves = spark.read.parquet(str(tmp_path / "cves"))
    installed = [(f"h{i % 3}", "v", f"p{i % 4}") for i in range(24)] + [(None, "v", "own7"), ("h", None, "p1"), ("h", "v", "none")]
    inventory = spark.createDataFrame(installed, "host STRING, vendor STRING, product STRING")
    want = sorted([("v", f"p{j}", 3, f"CVE-{i}") for j in range(4) for i in range(50)] + [("v", "own7", 0, "CVE-7")])
    for limit, join in ((joins.BROADCAST_ROWS, "BroadcastHashJoin"), (2, "SortMergeJoin")):
        monkeypatch.setattr(joins.broadcast_if_small, "__defaults__", (limit,))
        got = vu.match_software(inventory, cves)
        assert sorted((r.vendor, r.product, r.n_hosts, r.cve_id) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "BuildRight" not in plan
