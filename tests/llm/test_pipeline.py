"""The pipeline's stages, one after another, and the wiring of the eleven queries."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parlour.llm.common import table, written
from parlour.llm.decontaminate import decontaminated
from parlour.llm.exact_dedup import exact_dedup
from parlour.llm.simhash import near_dedup
from parlour.plans.check import compare, duck

SF = "/root/testdata/sf0.001"


def test_fourteen_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_exact_dedup_matches_its_sql_form(spark):
    r = compare(entry.queries()["op10_exact_dedup"](spark, SF), duck(SF), entry.oracle_sql()["op10_exact_dedup"])
    assert r["ok"], r


def test_each_stage_does_its_work_on_what_the_stage_before_kept(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, docs, SF), "test-stage")
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns and out.join(docs, "doc_id", "left_anti").count() == 0
        if k == 0:
            labels = table(spark, SF, "labels")
            kept = out.join(labels, "doc_id").groupBy("quality").count().collect()
            every = docs.join(labels, "doc_id").groupBy("quality").count().collect()
            kept, every = dict(map(tuple, kept)), dict(map(tuple, every))
            assert kept[1] == every[1] and kept.get(0, 0) <= 0.3 * every[0]
        elif k == 1:
            want = {r.doc_id for r in exact_dedup(docs, keep="max").filter("kept").collect()}
            assert {r.doc_id for r in out.collect()} == want
        elif k == 2:
            want = {r.component_id for r in near_dedup(docs).collect()}
            assert {r.doc_id for r in out.collect()} == want and near_dedup(out).agg(F.max("component_size")).first()[0] == 1
        elif k == 3:
            found = {r.doc_id for r in decontaminated(docs, table(spark, SF, "benchmark")).filter("contaminated").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - found
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > n[4]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (1, None), (2, "a b c " * 20_000), (2, "a b c " * 20_000), (3, "Plain words here.")]])
def test_stages_take_nulls_repeated_rows_and_empty_tables(spark, make_docs, rows):
    docs = make_docs(rows)
    for k, (_, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, docs, SF), "test-stage")
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
        docs = out
    assert (docs.count() > 0) == bool(rows)


def test_exploded_sides_are_not_broadcast(spark, monkeypatch):
    """Points, seeds and verified windows are small files, but not once they are exploded."""
    from parlour.llm import decontaminate, simhash

    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, tag: plans.append((tag, plan(df))) or plain(df, tag))
    points = plain(spark.createDataFrame([(i * 977,) for i in range(50)], "fp long"), "test-points")
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, "nothing of it")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"))
    plans += [("links", plan(simhash.near_links(points))), ("found", plan(found))]
    joined = {tag: p for tag, p in plans if "Join" in p}
    assert set(joined) == {"op7-verified", "links", "found"}
    assert not [tag for tag, p in joined.items() if "Broadcast" in p]
    assert [r.doc_id for r in found.collect()] == [1]
