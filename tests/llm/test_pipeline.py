import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from soukline.llm import mixing, packing, queries

from .conftest import clean

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "secret_scan", "source_mix", "best_fit_packing"]


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_stages_take_effect(spark, tmp_path):
    rows = [(k, clean(k, words=90), "en", f"s{k % 3}", 1) for k in range(240)]
    rows += [(1000 + k, clean(5, words=90), "en", "s1", 1) for k in range(30)]  # copies of 5
    rows += [(2000, "too short", "en", "s1", 1), (3000, clean(3000, words=90) + " token=abcdefghijklmnop", "en", "s2", 1)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(out := str(tmp_path / name))
            docs = spark.read.parquet(out)
            seen.append(docs.collect())
    good, unique, masked, mix = seen
    assert {r.doc_id for r in good} == {r[0] for r in rows} - {2000}
    assert {r.doc_id for r in unique} == {r[0] for r in rows if r[0] < 1000 or r[0] == 3000} and len(unique) == 241
    assert {r.doc_id for r in masked} == {r.doc_id for r in unique}
    assert [r.text.endswith("[SECRET]") for r in masked if r.doc_id == 3000] == [True]
    taken = {r.doc_id: r.taken // r.size for r in mixing.op9(spark.read.parquet(str(tmp_path / "secret_scan"))).collect()}
    assert sorted(r.doc_id for r in mix) == sorted(d for d, n in taken.items() for _ in range(n))
    packed = docs.collect()
    assert sum(r.n_words for r in packed) == sum(len(r.text.split()) for r in mix)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, run), key=str) == sorted(map(tuple, packed), key=str)


@data
def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert packing.packed(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect() == []
