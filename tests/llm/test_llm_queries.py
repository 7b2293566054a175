"""Registered queries on the smallest tables: SQL twins, contracts, pipeline."""

import os
import zlib

import pytest

import corpus_pipeline
from compare import duck, rows_of
from sievewatch.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["op2_line_templates", "op3_byte_bpe", "op5_ngram_join", "op6_even_shards", "op9_personal_data"])
def test_one_row_per_document(spark, con, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").collect())
    assert ids == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_held_out_accuracy(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op1_language"](spark, FOLDER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.85 * len(held)


def test_pipeline(spark, con, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder, columns = str(tmp_path), docs.columns
    first = docs.where("length(text) > 400").orderBy("doc_id").first()
    shouted = "".join(c.upper() if c.isascii() else c for c in first.text)
    extra = [
        (10_000, shouted, first.lang, "s", 1), (10_001, first.text + " tail", first.lang, "s", 1),
        (10_002, None, None, None, None), (10_003, "", None, None, None), (10_004, "12 34", None, None, None),
    ]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    table, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, folder)
        out.write.parquet(f"{folder}/{name}")
        table = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert table.columns == columns
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
    language, copies, near, private, packed = kept
    assert not language & {10_002, 10_003, 10_004} and language >= {10_000, 10_001, first.doc_id}
    assert 10_000 in copies and first.doc_id not in copies
    assert 10_001 not in near and near == private == packed
    assert corpus_pipeline.run(spark, folder).count() == table.count()
