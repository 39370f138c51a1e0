"""Candidates of several strategies, mined once."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import mine
from assaykit.plans import render
from assaykit.plans.more_queries import QUERIES, _orders, _parts

SF = "/root/testdata/sf0.001"
TEXTS = (
    ("p1", "The yield was 5 % at 20 C.", ["Results"]), ("p2", "Cells were treated with 20 uM and the yield increased two fold.", []), (None, "The yield was 7 %.", ["Results"]),
    ("p4", "The yield was 8 %.", ["Materials and Methods"]), ("p5", "We saw 5 mg.", None), ("p6", "Nothing was higher than before, 3 mg", ["Methods / Results"]), ("p7", None, []),
)


def test_each_strategy_has_its_candidates(spark):
    given = spark.createDataFrame([(list(TEXTS),)], "t array<struct<id:string,text:string,path:array<string>>>")
    whole = F.transform("t", lambda x: F.struct(x["id"].alias("id"), F.lit(0).alias("page"), x["text"].alias("text"), F.lit("").alias("section"), x["path"].alias("section_path"), F.lit(None).cast("array<double>").alias("bbox")))
    mixed = render._package(given.select(F.lit("d").alias("doc_id"), F.lit(1).alias("n"), "t"), paragraphs=whole)
    tables = _parts(spark, SF).withColumn("tables", F.transform("tables", lambda t: t.withField("section_path", F.when(F.col("doc_ordinal") % 2 == 0, F.array(F.lit("Methods"))))))
    docs = mixed.unionByName(tables).unionByName(render.supplier_documents(render.table(spark, SF, "supplier")))
    once = mine.candidates_by_strategy(docs).select("id", "doc_id", "ord", "strategies").collect()
    for s in mine.STRATEGIES:
        want = sorted((r.id, r.doc_id, r.ord) for r in mine.candidates(docs, s).select("id", "doc_id", "ord").collect())
        assert want and sorted((r.id, r.doc_id, r.ord) for r in once if s in r.strategies) == want, s
    with pytest.raises(ValueError):
        mine.candidates_by_strategy(docs, ("all",))


def test_strategies_are_counted_in_one_pass(spark):
    """Parts and line items are read no more often for three strategies than for one."""
    plan = QUERIES["strategy_counts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("relation [") == 3
    docs = _orders(spark, SF).limit(0).unionByName(_parts(spark, SF).limit(0))
    assert mine.candidates_by_strategy(docs).count() == 0


def test_relations_are_sought_where_a_word_stands(spark):
    df = spark.createDataFrame([("The dose was INCREASED in cells",), ("Sample 5 achieved a yield of 4 %",), (None,)], "t string").select(tx.relation(F.col("t")).alias("r"))
    assert [r.r and r.r.value for r in df.collect()] == ["increased", None, None] and "contains" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_claims_alone_are_scored_with_one_mining(spark):
    """Line items are read for candidates and for their provenance, and each measure has the same figures alone as with others."""
    from assaykit.operators import curate, score
    from assaykit.plans.queries import _expected

    plan = QUERIES["claim_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in x and "l_linenumber" in x for x in plan.split("\n")) == 2  # candidates, provenance
    docs = _parts(spark, SF)
    s, e = curate.to_samples(mine.table_candidates(docs), docs), _expected(spark, SF)
    whole, alone = score.score_documents(s, e), score.score_documents(s, e, measures=("claims",))
    assert sorted(alone.collect()) == sorted(whole.select(*alone.columns).collect()) and "locator_recall" not in alone.columns
    assert score.score_strategies(alone).first()["claim_recall"] == score.score_strategies(whole).first()["claim_recall"]
    with pytest.raises(ValueError):
        score.score_documents(s, e, measures=("locators",))
