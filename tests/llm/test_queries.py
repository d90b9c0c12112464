"""Queries with SQL against DuckDB; the pipeline stage by stage."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegrid.llm import lines, simhash
from tidegrid.llm import queries as Q


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = Q.queries()[name](spark, sf)
    want = con.execute(Q.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want[columns].values.tolist())


def test_pipeline(spark, sf, tmp_path):
    """Each stage on what the one before wrote: columns, and decisions that hold when they are made anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == columns
    assert lines.repeated_lines(seen["line_dedup"]).count() == 0
    assert simhash.keep_one(seen["simhash_near_dedup"]).count() == seen["simhash_near_dedup"].count()
    assert seen["bpe"].count() == seen["mixing"].count() > 0
    toxic = {r.doc_id for r in Q.op4_toxicity_chain(spark, sf).where("toxic").collect()}
    assert not toxic & {r.doc_id for r in seen["toxicity"].select("doc_id").collect()}


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    """run() itself, on nulls, empty and long texts, repeated rows and clashing columns, and on an empty table."""
    wide = docs.withColumn("p_toxic", F.lit("x")).withColumn("mix_time", F.lit(1)).withColumn("h", F.lit("y"))
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", wide), ("empty", wide.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        kept = {r.doc_id for r in got}
        assert kept <= {r.doc_id for r in rows.select("doc_id").collect()}
        # 2 loses all lines to 1 and stands for the texts without words; the mix may leave out any of the others
        assert kept == set() if name == "empty" else kept and not kept & {3, 4, 5, 8}
