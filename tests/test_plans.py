"""What the optimizer makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlift.operators.gold import (
    margin_by_material, margin_by_segment, margins_by_cut, margins_of_lines, segment_margins,
)
from ledgerlift.operators.sales import add_margins, dedupe_first, enrich_sales, equi_join
from ledgerlift.operators.search import knn_join, nearest
from ledgerlift.plans.adapters import VIEWS, erp_table
from ledgerlift.plans.pipeline import silver_tables
from ledgerlift.schemas import ContractError


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def silver(spark, sf_dir):
    tables = {name: erp_table(spark, sf_dir, name) for name in VIEWS}
    for name, key in (("customer_master", "customer_id"), ("material_master", "material_id")):
        tables[name] = dedupe_first(tables[name], key, "row_no")
    return silver_tables(tables)


def test_unused_masters_are_not_joined(silver):
    text = plan(margin_by_material(silver["sales_enriched"]))
    assert "customer.parquet" not in text and "part.parquet" not in text
    assert "customer.parquet" in plan(margin_by_segment(silver["sales_enriched"]))


def test_gold_reads_only_what_it_needs(spark, silver, tmp_path):
    path = str(tmp_path / "sales")
    silver["sales_enriched"].write.parquet(path)
    text = margin_by_material(spark.read.parquet(path))._jdf.queryExecution().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "order_id", "material_id", "net_value", "estimated_cost", "margin_pct", "is_margin_squeeze"
    }


def test_aggregates_combine_before_the_shuffle(silver):
    for df in (margin_by_material(silver["sales_enriched"]), margins_by_cut(silver["sales_enriched"])):
        assert "partial_sum(net_value" in plan(df)


def test_margins_by_cut_scans_sales_once(silver):
    assert plan(margins_by_cut(silver["sales_enriched"])).count("lineitem.parquet") == 1


def test_dedupe_combines_before_the_shuffle(spark, tmp_path):
    """A third of the rows share one key; each task still sends a single row for it."""
    path = str(tmp_path / "master")
    skewed = spark.range(0, 90_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"), F.col("id").alias("pos"),
    )
    skewed.write.parquet(path)
    found = dedupe_first(spark.read.parquet(path), "k", "pos")
    assert "partial_min_by" in plan(found)
    assert found.where("k = 'hot'").first()["v"] == 0 and found.count() == 60_001


def test_hot_keys_are_split_in_the_joins(spark):
    """Half of the lines belong to one order, half of the orders to one customer."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        header = spark.range(0, 4000, 1, 4).select(
            F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id")).alias("customer_id"),
            F.lit("EUR").alias("currency"), F.lit("D").alias("distribution_channel"), F.lit("S").alias("sales_org"),
        )
        items = spark.range(0, 80_000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, F.lit(8)).otherwise(F.col("id") % 4000).alias("order_id"),
            F.concat(F.lit("M"), F.col("id") % 7).alias("material_id"),
            F.xxhash64("id").cast("double").alias("net_value"), F.xxhash64("id", "id").cast("double").alias("estimated_cost"),
        )
        customer = spark.range(0, 4000, 1, 4).select(F.col("id").alias("customer_id"), F.lit("I").alias("industry"), F.lit("R").alias("region_group"))
        sales = enrich_sales(header, items, customer)
        counted = sales.groupBy("industry").agg(F.count(F.lit(1)).alias("count"), F.sum("margin_pct"))
        assert sorted(r["count"] for r in counted.collect()) == [40_000, 40_000]
        assert "SortMergeJoin(skew=true)" in plan(counted)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_searches_have_no_cross_join(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    single = plan(nearest(vectors, [0.0] * 64, 3, id="vec_id", vector="embedding"))
    assert "TakeOrderedAndProject" in single and "Exchange" not in single
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    for limits in ({}, {"queries_per_block": 10}):
        text = plan(knn_join(
            queries, vectors, 3, query_id="query_id", id="vec_id", query_vector="embedding", vector="embedding", dim=64, **limits
        ))
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "WindowGroupLimit" in text and "Partial" in text


def test_lines_are_aggregated_before_they_meet_customers(spark, sf_dir):
    """Beyond a broadcast too, what is shuffled by customer is partial rows only."""
    header = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("order_id"), (F.col("id") % 40).alias("customer_id"), F.lit("USD").alias("currency"),
        F.lit("web").alias("distribution_channel"), F.when(F.col("id") % 3 == 0, "S").alias("sales_org"),
    )
    items = spark.range(0, 8000, 1, 4).select(
        (F.col("id") % 4000).alias("order_id"), (F.col("id") % 7).cast("string").alias("material_id"),
        (F.col("id") % 90 + 10.0).alias("net_value"), F.when(F.col("id") % 11 > 0, F.col("id") % 80 + 5.0).alias("estimated_cost"),
    )
    customers = spark.range(35).select(
        F.col("id").alias("customer_id"), (F.col("id") % 3).cast("string").alias("industry"),
        F.when(F.col("id") % 2 == 0, "R").alias("region_group"))
    lines = add_margins(equi_join(header, items, "order_id", "inner"))
    joined = add_margins(equi_join(equi_join(header, items, "order_id", "inner"), customers, "customer_id", "left"))
    names = sorted(margins_by_cut(joined).columns)

    def found(df):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for basis in ("local", "usd"):
            assert found(margins_of_lines(lines, customers, basis)) == found(margins_by_cut(joined, basis))
        own = [tuple(r) for r in segment_margins(lines, customers).collect()]
        assert sorted(map(str, own)) != [] and len(own) == len(margin_by_segment(joined).collect())
        for df in (margins_of_lines(lines, customers), segment_margins(lines, customers)):
            text = plan(df).splitlines()
            places = [i for i, x in enumerate(text) if "Exchange hashpartitioning(customer_id" in x and "order_id" not in x]
            below = ["\n".join(text[i + 1:i + 3]) for i in places]
            assert places and all("Aggregate" in x or "Range" in x or "Project [id" in x for x in below), below
            assert any("Aggregate" in x for x in below)
        with pytest.raises(ContractError, match="industry"):
            segment_margins(joined, customers)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sales_rows_are_not_shuffled_for_a_small_stored_master(spark, sf_dir):
    import __spark_entry__ as entry

    def joins(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return plan.count("BroadcastHashJoin"), plan

    stored, plan = joins(entry._silver(spark, sf_dir, "sales_enriched", stored=True))
    assert stored >= 2 and "masters-" in plan
