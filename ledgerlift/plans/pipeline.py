"""The medallion jobs: Bronze to Silver, Silver to Gold, Gold to vectors and answers."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlift.operators.checks import (
    combine_reports, require_passed, validate_controlling, validate_delivery, validate_sales,
)
from ledgerlift.operators.context import gold_context
from ledgerlift.operators.embedding import Embedder, embed_texts
from ledgerlift.operators.gold import GOLD_TABLES, MARGIN_TABLES, margins_by_cut, pick_cut, unsorted_gold
from ledgerlift.operators.insights import insights_all
from ledgerlift.operators.mapping import apply_mapping, missing_types
from ledgerlift.operators.sales import conform, dedupe_first, enrich_sales
from ledgerlift.operators.search import semantic_search
from ledgerlift.schemas import (
    EMBEDDING_DIM, OPTIONAL_TYPES, PRESET_SAP, PRESET_SAP_FILES, REQUIRED_TYPES, ContractError, require_columns,
)
from ledgerlift.sources.bronze import bronze_name, land_bronze, read_bronze
from ledgerlift.sources.layers import (
    SILVER_TABLES, VECTOR_SCHEMA, current_run, gold_ready, load_mapping, publish, read_gold, read_silver,
    read_vectors, run_path, write_layer, write_vectors,
)
from ledgerlift.sources.shared import shuffles_dropped, side_by_side

log = logging.getLogger(__name__)

_MASTERS = {"customer_master": "customer_id", "material_master": "material_id"}


@dataclass(frozen=True)
class RowBounds:
    """Row counts that the checks accept. There is no upper bound unless one is given."""

    min_sales: int = 500
    max_sales: int | None = None
    min_controlling: int = 50
    min_delivery: int = 50


# The bounds that suit the small exports of a pilot.
PILOT_BOUNDS = RowBounds(max_sales=5000)


@dataclass(frozen=True)
class SilverRun:
    """Outcome of a Silver run; ``missing`` names the required data types that kept it from running."""

    ran: bool
    run_id: str | None = None
    missing: tuple[str, ...] = field(default=())


def _load(
    spark: SparkSession, bronze: str, silver: str, run_id: str, data_type: str, file: str, mapping,
    multiline: bool = False,
) -> DataFrame:
    """One landed export under canonical names, measures cast, masters unique per key.

    Deduplicated masters are written to the run first. The planner then knows their true size: one
    below the broadcast threshold joins without moving the sales rows, a larger one is shuffled.
    """
    master_key = _MASTERS.get(data_type)
    raw = read_bronze(spark, f"{bronze}/{file}", with_position=master_key is not None, multiline=multiline)
    df = conform(require_columns(apply_mapping(raw, mapping), data_type))
    if master_key is None:
        return df
    path = run_path(silver, run_id, data_type)
    write_layer(dedupe_first(df, master_key), path)
    return spark.read.parquet(path)


def silver_tables(
    tables: Mapping[str, DataFrame], rates: Mapping[str, float] | None = None,
    observe: Mapping[str, Observation] | None = None,
) -> dict[str, DataFrame]:
    """The three Silver tables from canonical Bronze tables (masters unique per key).

    Observations named ``loaded_<data type>`` receive the row counts of the tables as loaded, the
    others those of ``enrich_sales``.
    """
    observe = observe or {}
    tables = {
        t: df.observe(observe[f"loaded_{t}"], F.count(F.lit(1)).alias("rows")) if f"loaded_{t}" in observe else df
        for t, df in tables.items()
    }
    return {
        "sales_enriched": enrich_sales(
            tables["sales_header"], tables["sales_items"], tables["customer_master"],
            tables.get("material_master"), rates=rates, observe=observe,
        ),
        "controlling_enriched": tables["controlling"],
        "delivery_enriched": tables["delivery"],
    }


def write_silver(
    spark: SparkSession, tables: Mapping[str, DataFrame], silver: str, bounds: RowBounds = RowBounds(),
    run_id: str | None = None,
) -> str:
    """Write Silver tables as a new run, check what was written, publish all or nothing.

    The joins run once, for the write; the tables are written side by side, and what the joins shuffled goes when
    they are. The checks then read back only the columns they need. A run that fails its checks stays unlisted, with its
    report in ``checks``, and readers keep the run published before.
    """
    run_id = run_id or uuid.uuid4().hex
    with shuffles_dropped(spark):
        side_by_side(spark, [partial(write_layer, df, run_path(silver, run_id, name)) for name, df in tables.items()])
    staged = {name: spark.read.parquet(run_path(silver, run_id, name)) for name in tables}
    report = combine_reports(
        sales=validate_sales(staged["sales_enriched"], bounds.min_sales, bounds.max_sales),
        controlling=validate_controlling(staged["controlling_enriched"], bounds.min_controlling),
        delivery=validate_delivery(staged["delivery_enriched"], bounds.min_delivery),
    )
    report_path = run_path(silver, run_id, "checks")
    write_layer(report, report_path)
    require_passed(spark.read.parquet(report_path))
    publish(spark, silver, run_id)
    return run_id


def run_from_mapping(
    spark: SparkSession, config: str, bronze: str, silver: str, *,
    bounds: RowBounds = RowBounds(), rates: Mapping[str, float] | None = None,
    observe: Mapping[str, Observation] | None = None, multiline: bool = False,
) -> SilverRun:
    """Bronze to Silver by the confirmed mapping.

    ``multiline`` allows line breaks inside quotes, for exports that are read as they are.

    Without a mapping file, or when it lacks a required data type, nothing is written and
    ``ran`` is False. A mapping file that is no JSON object is an error. A failed check raises
    ``ChecksFailed`` and publishes nothing. For ``observe`` see ``enrich_sales``.
    """
    mapping = load_mapping(spark, config, strict=True)
    if mapping is None:
        return SilverRun(ran=False, missing=REQUIRED_TYPES)
    missing = tuple(r["data_type"] for r in missing_types(mapping).collect())
    if missing:
        return SilverRun(ran=False, missing=missing)

    # One row per header of six exports: the plan of the renames is built from it.
    entries: dict[str, tuple[str, list[tuple[str, str | None]]]] = {}
    used = mapping.where(F.col("data_type").isin(*REQUIRED_TYPES, *OPTIONAL_TYPES))
    for row in used.orderBy("data_type", "position").collect():
        _, pairs = entries.setdefault(row["data_type"], (row["file"], []))
        if row["header"] is not None:
            pairs.append((row["header"], row["canonical"]))
    wanted = [t for t in (*REQUIRED_TYPES, *OPTIONAL_TYPES) if t in entries]
    nameless = [t for t in wanted if not entries[t][0]]
    if nameless:
        raise ContractError(f"the mapping names no file for {', '.join(nameless)}")
    run_id = uuid.uuid4().hex
    loads = [partial(_load, spark, bronze, silver, run_id, t, *entries[t], multiline) for t in wanted]
    tables = dict(zip(wanted, side_by_side(spark, loads), strict=True))
    write_silver(spark, silver_tables(tables, rates, observe), silver, bounds, run_id)
    return SilverRun(ran=True, run_id=run_id)


def land_native(
    spark: SparkSession, exports: str, bronze: str, *, multiline: bool = False, clean_source: bool = False,
    types: Iterable[str] = tuple(PRESET_SAP_FILES),
) -> None:
    """Land the exports of the native layout from folder ``exports``, side by side: all six, or those of some data types.

    With ``clean_source`` each export is deleted once it is landed.
    """
    side_by_side(spark, [
        partial(land_bronze, spark, f"{exports}/{PRESET_SAP_FILES[t]}", bronze, multiline=multiline, clean_source=clean_source)
        for t in types
    ])


def run_native(
    spark: SparkSession, bronze: str, silver: str, *, landed: bool = False,
    bounds: RowBounds = RowBounds(), rates: Mapping[str, float] | None = None, multiline: bool = False,
) -> SilverRun:
    """Bronze to Silver for exports in the native SAP-style layout, whose names are known.

    Reads the CSV files as they are, or with ``landed`` what ``land_native`` made of them.
    """
    files = {t: bronze_name(f) if landed else f for t, f in PRESET_SAP_FILES.items()}
    run_id = uuid.uuid4().hex
    loads = [partial(_load, spark, bronze, silver, run_id, t, files[t], PRESET_SAP[t], multiline) for t in PRESET_SAP]
    tables = dict(zip(PRESET_SAP, side_by_side(spark, loads), strict=True))
    write_silver(spark, silver_tables(tables, rates), silver, bounds, run_id)
    return SilverRun(ran=True, run_id=run_id)


def write_gold(tables: Mapping[str, DataFrame], gold: str, *, basis: str = "local") -> None:
    """Write the six Gold tables from Silver tables given by name, and publish them together.

    A build that fails leaves the Gold published before as it is.

    The four margin tables come from one pass over the sales table. What that pass leaves is as
    small as the Gold tables; it is written once and the four are sorted out of it.
    """
    sales, run_id = tables["sales_enriched"], uuid.uuid4().hex
    spark = sales.sparkSession
    cuts_path = run_path(gold, run_id, "margins_by_cut")
    side_by_side(spark, [partial(write_layer, margins_by_cut(sales, basis), cuts_path)] + [
        partial(write_layer, unsorted_gold(tables[table.source], name), run_path(gold, run_id, name))
        for name, table in GOLD_TABLES.items() if name not in MARGIN_TABLES
    ])
    cuts = spark.read.parquet(cuts_path)
    side_by_side(spark, [
        partial(write_layer, pick_cut(cuts, name, ordered=False), run_path(gold, run_id, name)) for name in MARGIN_TABLES
    ])
    publish(spark, gold, run_id)


def build_gold(spark: SparkSession, silver: str, gold: str, *, basis: str = "local") -> None:
    """Write the six Gold tables from the Silver run published last."""
    run_id = current_run(spark, silver)
    write_gold({name: read_silver(spark, silver, name, run_id) for name in SILVER_TABLES}, gold, basis=basis)


def load_gold_context(spark: SparkSession, gold: str) -> DataFrame | None:
    """The context lines of all Gold tables in order, or None when Gold has not been built."""
    return gold_context(read_gold(spark, gold)) if gold_ready(spark, gold) else None


def build_vectors(
    spark: SparkSession, gold: str, vectors: str, *, embedder: Embedder | None = None, dim: int = EMBEDDING_DIM
) -> None:
    """Publish the embedded insight sentences of Gold as the new vector table."""
    sentences = insights_all(read_gold(spark, gold))
    write_vectors(embed_texts(sentences, embedder=embedder, dim=dim), vectors, dim)


def search_store(
    spark: SparkSession, query: str, vectors: str, limit: int, *,
    embedder: Embedder | None = None, dim: int = EMBEDDING_DIM, metric: str = "l2", digits: int | None = None,
) -> DataFrame:
    """The ``limit`` stored texts nearest to a query text; ``digits`` as in ``nearest``.

    No vector table, or a query that cannot be embedded, gives an empty result.
    """
    nothing = spark.createDataFrame([], VECTOR_SCHEMA).select(
        "text", "table_name", F.lit(None).cast("double").alias("distance")
    )
    run_id = current_run(spark, vectors)
    if run_id is None:
        return nothing
    question = spark.createDataFrame([(query,)], "text string")
    try:
        point = embed_texts(question, embedder=embedder, dim=dim).first()["vector"]
    except PythonException as problem:  # the embedder's; a failing cluster is no empty answer
        log.warning("query not embedded: %s", problem)
        return nothing
    return semantic_search(read_vectors(spark, vectors, run_id), point, limit, metric, digits)


def run_all(
    spark: SparkSession, config: str, bronze: str, silver: str, gold: str, vectors: str, *,
    bounds: RowBounds = RowBounds(), rates: Mapping[str, float] | None = None,
    embedder: Embedder | None = None, dim: int = EMBEDDING_DIM, multiline: bool = False,
) -> SilverRun:
    """The whole pipeline. When the mapping is incomplete, Gold and vectors stay as they are."""
    run = run_from_mapping(spark, config, bronze, silver, bounds=bounds, rates=rates, multiline=multiline)
    if run.ran:
        build_gold(spark, silver, gold)
        build_vectors(spark, gold, vectors, embedder=embedder, dim=dim)
    return run

