"""Registered queries: each runs a library operator over whole tables.

``queries()`` and ``oracle_sql()`` share their keys and column names.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import partial, reduce
from pathlib import Path

_ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(_ROOT))

from pyspark import cloudpickle  # noqa: E402
from pyspark.errors import PySparkException  # noqa: E402
from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import ledgerlift  # noqa: E402
from ledgerlift.operators import checks, context, mapping  # noqa: E402
from ledgerlift.operators.embedding import embed_texts  # noqa: E402
from ledgerlift.operators.gold import (  # noqa: E402
    GOLD_BUILDERS, GOLD_TABLES, margins_by_cut, margins_of_lines, segment_margins,
)
from ledgerlift.operators.insights import INSIGHT_BUILDERS, insights_all  # noqa: E402
from ledgerlift.operators.sales import add_margins, conform, dedupe_first, enrich_sales, equi_join  # noqa: E402
from ledgerlift.operators.search import knn_join, nearest  # noqa: E402
from ledgerlift.plans import pipeline  # noqa: E402
from ledgerlift.plans.adapters import (  # noqa: E402
    DOCUMENT_LINES, EXPORT_HEADERS, MAPPING_ROWS, VIEWS, erp_table, view,
)
from ledgerlift.schemas import EMBEDDING_DIM, KNOWN_CODES, PRESET_SAP, PRESET_SAP_FILES  # noqa: E402
from ledgerlift.sources import bronze, layers  # noqa: E402
from ledgerlift.sources.shared import shuffles_dropped, side_by_side, work_dir  # noqa: E402
from ledgerlift.streaming.landing import compact_landed, drop_gathered, land_bronze_stream  # noqa: E402

# Tasks get the library's functions with the job, so nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(ledgerlift)

_MASTER_KEYS = {"customer_master": "customer_id", "material_master": "material_id"}
_VECTOR_DIM = 64


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded: engines add up in different order."""
    doubles = [f.name for f in df.schema.fields if f.dataType == T.DoubleType()]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An ERP table, masters unique per key."""
    df = erp_table(spark, sf_dir, name)
    return dedupe_first(df, _MASTER_KEYS[name], "row_no") if name in _MASTER_KEYS else df


def _silver(spark: SparkSession, sf_dir: str, name: str, *, stored: bool = False) -> DataFrame:
    """One Silver table.

    With ``stored`` the masters are written first, as in a real run: the planner then knows their size and does not
    shuffle the sales rows for a small one. Without it, the optimizer drops masters that the query does not use.
    """
    if name == "controlling_enriched":
        return _table(spark, sf_dir, "controlling")
    if name == "delivery_enriched":
        return _table(spark, sf_dir, "delivery")
    parts = ("sales_header", "sales_items", "customer_master", "material_master")
    tables = {part: _table(spark, sf_dir, part) for part in parts}
    if stored:
        folder = work_dir(spark, "masters")
        for master in _MASTER_KEYS:
            layers.write_layer(tables[master], f"{folder}/{master}")
            tables[master] = spark.read.parquet(f"{folder}/{master}")
    return enrich_sales(*tables.values())


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with margins, without their customers."""
    header, items = (conform(_table(spark, sf_dir, name)) for name in ("sales_header", "sales_items"))
    return add_margins(equi_join(header, items, "order_id", "inner"))


def _gold(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All Gold tables, written and read back as in a real run.

    Doubles are rounded, so that text made of them does not depend on the order of summation.
    """
    path = work_dir(spark, "gold")
    pipeline.write_gold({name: _silver(spark, sf_dir, name) for name in layers.SILVER_TABLES}, path)
    return {name: _rounded(df) for name, df in layers.read_gold(spark, path).items()}


def _gold_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Gold table straight from Silver."""
    return _rounded(GOLD_BUILDERS[name](_silver(spark, sf_dir, GOLD_TABLES[name].source)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- mapping -------------------------------------------------------------------------------------

def _mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MAPPING_ROWS)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mapping_rows(spark, sf_dir)
    is_new = F.col("origin").eqNullSafe("R")
    return mapping.upsert_mapping(
        rows.where(~is_new).drop("origin"), rows.where(is_new).drop("origin"), ("tenant", "data_type")
    )


def _mapping_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row becomes a mapping document with a second, unmapped header, and is read back."""
    nothing = F.lit(None).cast("string").alias("canonical")
    items = F.array(F.struct("header", "canonical"), F.struct(F.lit("other").alias("header"), nothing))
    entry = F.create_map("data_type", F.struct("file", items.alias("mapping")))
    documents = _mapping_rows(spark, sf_dir).select("tenant", F.to_json(entry).alias("value"))
    return layers.parse_mapping(documents, keep=["tenant"])


def _apply_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = view(spark, sf_dir, VIEWS["sales_header"])
    code_of = {field: code for code, field in KNOWN_CODES.items()}
    coded = header.withColumnsRenamed({c: code_of[c] for c in header.columns if c in code_of})
    return mapping.apply_mapping(coded, KNOWN_CODES)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.match_headers(view(spark, sf_dir, EXPORT_HEADERS))


# --- exports, landing and the whole pipeline --------------------------------------------------------

def _export(spark: SparkSession, sf_dir: str, folder: str, files: dict[str, str], names, types=tuple(VIEWS)) -> None:
    """Write ERP tables, by default all, as CSV exports, side by side; ``names`` renames a table's columns."""
    def write(data_type: str) -> None:
        df = erp_table(spark, sf_dir, data_type)
        if "row_no" in df.columns:
            df = df.orderBy("row_no").drop("row_no")  # file order is what decides the first row
        renamed = df.withColumnsRenamed(names(data_type))
        renamed.write.option("header", True).option("escape", '"').csv(f"{folder}/{files[data_type]}")

    side_by_side(spark, [partial(write, data_type) for data_type in types])


def _item_columns(df: DataFrame) -> DataFrame:
    return conform(df).select("order_id", "line_item_number", "material_id", "net_value", "estimated_cost")


def _exported_items(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    folder = work_dir(spark, "items")
    items = view(spark, sf_dir, VIEWS["sales_items"])
    items.write.option("header", True).option("escape", '"').csv(f"{folder}/items.csv")
    return folder, f"{folder}/items.csv"


def _read_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_columns(bronze.read_bronze(spark, _exported_items(spark, sf_dir)[1]))


def _read_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, exported to one file and read back by several tasks."""
    folder = work_dir(spark, "quoted-export")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    documents.write.option("header", True).option("escape", '"').csv(f"{folder}/documents.csv")
    read = bronze.read_bronze(spark, f"{folder}/documents.csv", multiline=True)
    return read.select("doc_id", "source", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def _land_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, export = _exported_items(spark, sf_dir)
    name = bronze.land_bronze(spark, export, f"{folder}/bronze")
    return _item_columns(bronze.read_bronze(spark, f"{folder}/bronze/{name}"))


def _land_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, export = _exported_items(spark, sf_dir)
    target = f"{folder}/landed.parquet"
    land_bronze_stream(spark, export, target, f"{folder}/checkpoint").awaitTermination()
    return _item_columns(bronze.read_bronze(spark, target))


def _land_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports landed one file at a time; the small files are gathered, and the batch landed last is not."""
    folder = work_dir(spark, "items")
    items = view(spark, sf_dir, VIEWS["sales_items"]).repartition(4)
    items.write.option("header", True).option("escape", '"').csv(f"{folder}/items.csv")
    target = f"{folder}/landed.parquet"
    land_bronze_stream(spark, f"{folder}/items.csv", target, f"{folder}/checkpoint", max_files_per_batch=1).awaitTermination()
    compact_landed(spark, target)
    drop_gathered(spark, target)
    return _item_columns(bronze.read_bronze(spark, target))


_BOUNDS = pipeline.RowBounds(max_sales=None)
_EXPORTS_AT_ONCE = 2  # so many lie on the disk beside what is landed of them


def _pipeline_silver(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Export under ERP codes, confirm the mapping of all types, run to Silver."""
    folder = work_dir(spark, "pipeline")
    code_of = {field: code for code, field in KNOWN_CODES.items()}
    files = {t: f"{t}.csv" for t in VIEWS}
    _export(spark, sf_dir, f"{folder}/bronze", files, lambda _: code_of)
    read = side_by_side(spark, [partial(bronze.read_bronze, spark, f"{folder}/bronze/{file}") for file in files.values()])
    mapping_rows = [
        (data_type, file, i, header, KNOWN_CODES.get(header))
        for (data_type, file), df in zip(files.items(), read, strict=True) for i, header in enumerate(df.columns)
    ]
    confirmed = spark.createDataFrame(mapping_rows, mapping.MAPPING_SCHEMA)
    layers.save_mapping(confirmed, f"{folder}/config")
    run = pipeline.run_from_mapping(
        spark, f"{folder}/config", f"{folder}/bronze", f"{folder}/silver", bounds=_BOUNDS
    )
    assert run.ran, run
    return folder, f"{folder}/silver"


def _sales_columns(sales: DataFrame) -> DataFrame:
    return sales.select(
        "order_id", "customer_id", "currency", "material_id", "net_value", "industry", "region_group",
        "material_description", "netwr_usd", F.round("margin_pct", 6).alias("margin_pct"),
        "is_margin_squeeze", "is_mat01_squeeze",
    )


def _pipeline_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, silver = _pipeline_silver(spark, sf_dir)
    return _sales_columns(layers.read_silver(spark, silver, "sales_enriched"))


def _pipeline_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "native")

    def land(data_type: str) -> None:
        """Export a table and land it. The exports are twice as large as Bronze, and nothing reads them once they are landed."""
        _export(
            spark, sf_dir, f"{folder}/exports", PRESET_SAP_FILES,
            lambda t: {canonical: native for native, canonical in PRESET_SAP[t].items()}, [data_type],
        )
        pipeline.land_native(spark, f"{folder}/exports", f"{folder}/bronze", clean_source=True, types=[data_type])

    with shuffles_dropped(spark):
        side_by_side(spark, [partial(land, data_type) for data_type in VIEWS], at_once=_EXPORTS_AT_ONCE)
    pipeline.run_native(spark, f"{folder}/bronze", f"{folder}/silver", landed=True, bounds=_BOUNDS)
    return _sales_columns(layers.read_silver(spark, f"{folder}/silver", "sales_enriched"))


def _metric_rows(records: dict[str, DataFrame]) -> DataFrame:
    """Keys, sort value and row count out of the JSON records of all metrics."""
    parts = []
    for name, df in records.items():
        table = GOLD_TABLES[name]
        counted = next(m for m in reversed(table.measures) if m.endswith("_count"))
        second = F.get_json_object("record", f"$.{table.keys[1]}") if len(table.keys) > 1 else F.lit(None)
        parts.append(df.select(
            F.lit(name).alias("metric"), F.get_json_object("record", f"$.{table.keys[0]}").alias("key_1"),
            second.cast("string").alias("key_2"),
            F.round(F.get_json_object("record", f"$.{table.sort}").cast("double"), 4).alias("sort_value"),
            F.get_json_object("record", f"$.{counted}").cast("bigint").alias("rows_counted"),
        ))
    return _union(parts)


def _metric_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_rows({n: layers.to_records(df) for n, df in _gold(spark, sf_dir).items()})


def _pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, silver = _pipeline_silver(spark, sf_dir)
    pipeline.build_gold(spark, silver, f"{folder}/gold")
    return _metric_rows({n: layers.metric_json(spark, f"{folder}/gold", n) for n in GOLD_TABLES})


# --- text and vectors --------------------------------------------------------------------------------

def _insight(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return INSIGHT_BUILDERS[name](_gold_table(spark, sf_dir, name))
    return run


def _context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return _union([
        context.context_lines(gold[n], n).select(F.lit(n).alias("table_name"), "line")
        for n in context.SECTIONS if n != "budget_variance"
    ])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _vectors(spark, sf_dir)
        probe = vectors.orderBy("vec_id").first()["embedding"]
        found = nearest(vectors, probe, 10, id="vec_id", vector="embedding", metric=metric)
        return found.select("vec_id", F.round("distance", 6).alias("distance"))
    return run


def _knn_join(metric: str, **limits):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _vectors(spark, sf_dir)
        found = knn_join(
            vectors.withColumnRenamed("vec_id", "query_id"), vectors, 5, query_id="query_id", id="vec_id",
            query_vector="embedding", vector="embedding", dim=_VECTOR_DIM, metric=metric, **limits,
        )
        return found.withColumn("distance", F.round("distance", 6))
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _documents(spark, sf_dir).select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    weight = F.round(F.col("weight").cast("double"), 6)
    return cells.where("weight <> 0").select("doc_id", "bucket", weight.alias("weight"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    question = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").select("text").limit(1)
    found = nearest(documents, embed_texts(question).first()["vector"], 10, id="doc_id")
    return found.select("doc_id", F.round("distance", 6).alias("distance"))


def _search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is built into a vector table, which answers with the five texts nearest by rounded distance, then text; a
    table that is missing adds nothing."""
    folder, question = work_dir(spark, "vectors"), "Which route has a critical delay?"
    # Gold with rounded numbers, so that the sentences do not depend on the order of summation.
    for name, df in _gold(spark, sf_dir).items():
        layers.write_layer(df, layers.run_path(f"{folder}/gold", "rounded", name))
    layers.publish(spark, f"{folder}/gold", "rounded")
    pipeline.build_vectors(spark, f"{folder}/gold", f"{folder}/vectors")
    found = pipeline.search_store(spark, question, f"{folder}/vectors", 5, digits=6)
    return found.unionByName(pipeline.search_store(spark, question, f"{folder}/missing", 5))


def _vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table as published, by a build that succeeds and one that fails after it."""
    path = f"{work_dir(spark, 'vector-table')}/vectors"
    sentences = insights_all(_gold(spark, sf_dir))
    layers.write_vectors(embed_texts(sentences, dim=_VECTOR_DIM), path, _VECTOR_DIM)
    try:
        layers.write_vectors(embed_texts(sentences, dim=_VECTOR_DIM), path, _VECTOR_DIM + 1)
    except PySparkException:
        pass  # the table stays
    table = layers.read_vectors(spark, path)
    return table.select("table_name", "text", F.size("vector").alias("cells"))


def _failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that passes its checks and is published, and one that fails them and is not."""
    silver = work_dir(spark, "gate")
    tables = {name: _silver(spark, sf_dir, name, stored=True) for name in layers.SILVER_TABLES}
    first = pipeline.write_silver(spark, tables, silver, _BOUNDS)
    try:
        pipeline.write_silver(spark, tables, silver, pipeline.RowBounds(max_sales=1))
        failed = False
    except checks.ChecksFailed:
        failed = True
    stays = layers.current_run(spark, silver) == first
    sales = layers.read_silver(spark, silver, "sales_enriched")
    return sales.agg(F.count("*").alias("sales_rows")).select(
        F.lit(failed).alias("failed"), F.lit(stays).alias("first_stays"), "sales_rows")


def _semantic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of the three documents nearest to each benchmark text."""
    questions = embed_texts(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    found = knn_join(
        questions, _documents(spark, sf_dir), 3, query_id="item_id", id="doc_id", dim=EMBEDDING_DIM, metric="l2"
    )
    return found.select("item_id", "rank", F.round("distance", 5).alias("distance"))


# --- checks, counts and sentinels --------------------------------------------------------------------

def _sales_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row count against bounds that hold it, and against two that do not."""
    sales = _silver(spark, sf_dir, "sales_enriched")
    return _union([
        checks.validate_sales(sales, *bounds).where("name = 'row_count_range'").select(
            F.lit(case).alias("bounds"), "passed", "severity")
        for case, bounds in {"wide": (500, 10**12), "low": (1, 10), "high": (10**12, None)}.items()
    ])


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that keep a run with too many sales rows from being published."""
    report = checks.combine_reports(
        sales=checks.validate_sales(_silver(spark, sf_dir, "sales_enriched"), 1, 10),
        controlling=checks.validate_controlling(_silver(spark, sf_dir, "controlling_enriched")),
        delivery=checks.validate_delivery(_silver(spark, sf_dir, "delivery_enriched")),
    )
    return checks.failed_checks(report).select("table", "name", "column", "bad_rows")


def _step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows loaded from each table and rows after each join."""
    names = ("sales_header", "sales_items", "customer_master", "material_master", "controlling", "delivery")
    tables = {n: _table(spark, sf_dir, n) for n in names}
    observe = {k: Observation() for k in (*(f"loaded_{n}" for n in names), "items", "customer", "material", "sales")}
    for df in pipeline.silver_tables(tables, observe=observe).values():
        df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, o.get["rows"]) for k, o in observe.items()], "step string, n_rows bigint")


def _sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether Gold counts as built, before and after it is."""
    folder = work_dir(spark, "sentinel")
    before = layers.gold_ready(spark, folder)
    pipeline.write_gold({name: _silver(spark, sf_dir, name) for name in layers.SILVER_TABLES}, folder)
    built = layers.metric(spark, folder, "margin_by_material").agg(F.count("*").alias("materials"))
    return built.select(F.lit(before).alias("before"), F.lit(layers.gold_ready(spark, folder)).alias("after"), "materials")


def _folder_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names of the written exports of all ERP tables, read from the files' first lines."""
    folder = work_dir(spark, "headers")
    _export(spark, sf_dir, folder, {t: f"{t}.csv" for t in VIEWS}, lambda _: {})
    found = bronze.extract_headers(spark, folder)
    table = F.regexp_extract("file", r"/(\w+)\.csv/[^/]*$", 1)
    return found.select(table.alias("table_name"), F.col("position").cast("bigint").alias("position"), "header").distinct()


# --- training-data operators: a subpackage that may be absent ---------------------------------------

try:
    from ledgerlift.llm.queries import QUERIES as _LLM_QUERIES
    from ledgerlift.llm.queries import SQL as _LLM_SQL

    import corpus_pipeline

    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": corpus_pipeline.run}
    _LLM_SQL = _LLM_SQL if corpus_pipeline.ORACLE_SQL is None else {**_LLM_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
except ModuleNotFoundError as missing:
    if missing.name not in ("ledgerlift.llm", "ledgerlift.llm.queries", "corpus_pipeline"):
        raise
    _LLM_QUERIES, _LLM_SQL = {}, {}


# --- contract --------------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: margins per material from joined and enriched sales."""
    return queries()["margin_by_material"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return {**core_queries(), **_LLM_QUERIES}


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that do not need the subpackage ``llm``."""
    silver, gold = _silver, _gold

    def gold_query(name: str):
        return lambda s, d: _gold_table(s, d, name)

    return {
        "sales_enriched": lambda s, d: silver(s, d, "sales_enriched"),
        "customer_dedupe": lambda s, d: _table(s, d, "customer_master"),
        "material_dedupe": lambda s, d: _table(s, d, "material_master"),
        **{name: gold_query(name) for name in GOLD_TABLES},
        "margin_by_material_usd": lambda s, d: _rounded(
            GOLD_BUILDERS["margin_by_material"](silver(s, d, "sales_enriched"), basis="usd")
        ),
        "margin_by_segment": lambda s, d: _rounded(segment_margins(_lines(s, d), _table(s, d, "customer_master"))),
        "margins_by_cut": lambda s, d: _rounded(margins_of_lines(_lines(s, d), _table(s, d, "customer_master"))),
        "margins_by_cut_joined": lambda s, d: _rounded(margins_by_cut(silver(s, d, "sales_enriched"))),
        "validate_sales": lambda s, d: checks.validate_sales(silver(s, d, "sales_enriched"), 500, None),
        "validate_controlling": lambda s, d: checks.validate_controlling(silver(s, d, "controlling_enriched")),
        "validate_delivery": lambda s, d: checks.validate_delivery(silver(s, d, "delivery_enriched")),
        "extract_headers": lambda s, d: bronze.header_rows(view(s, d, DOCUMENT_LINES), "line", "file"),
        "match_headers": _matches,
        "match_coverage": lambda s, d: mapping.match_coverage(_matches(s, d)),
        "missing_types": lambda s, d: mapping.missing_types(_mapping_rows(s, d), by=["tenant"]),
        "upsert_mapping": _upsert,
        "load_mapping": _mapping_documents,
        "apply_mapping": _apply_codes,
        **{f"insights_{name}": _insight(name) for name in INSIGHT_BUILDERS},
        "insights_all": lambda s, d: insights_all(gold(s, d)),
        "context_lines": _context_lines,
        "budget_context": lambda s, d: context.budget_context(_gold_table(s, d, "budget_variance")).select("part", "line"),
        "gold_context": lambda s, d: context.gold_context(gold(s, d)).select("section", "part", "line"),
        "knn_l2": _knn("l2"),
        "knn_cosine": _knn("cosine"),
        "knn_join_l2": _knn_join("l2"),
        "knn_join_cosine": _knn_join("cosine"),
        "knn_join_blocks": _knn_join("l2", queries_per_block=100, rows_per_part=200),
        "embed_texts": _embed,
        "semantic_search": _semantic,
        "search_store": _search_store,
        "semantic_search_batch": _semantic_batch,
        "validate_sales_bounds": _sales_bounds,
        "checks_gate": _gate,
        "failed_run": _failed_run,
        "vector_table": _vector_table,
        "step_counts": _step_counts,
        "gold_sentinel": _sentinel,
        "extract_headers_folder": _folder_headers,
        "read_bronze": _read_bronze,
        "read_quoted": _read_quoted,
        "land_bronze": _land_bronze,
        "land_bronze_stream": _land_stream,
        "land_compacted": _land_compacted,
        "metric_json": _metric_json,
        "pipeline_sales": _pipeline_sales,
        "pipeline_native_sales": _pipeline_native,
        "pipeline_metrics": _pipeline_metrics,
    }


def oracle_sql() -> dict[str, str]:
    """The same queries as SQL, with the same column names."""
    import oracle

    return {**oracle.oracle_sql(), **_LLM_SQL}
