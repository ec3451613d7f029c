"""Match headers to canonical fields, keep the confirmed mapping, apply it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions.headers import normalize_header, strip_space
from ledgerlift.schemas import KNOWN_CODES, REQUIRED_TYPES, SYNONYMS, ContractError

KNOWN, HEURISTIC, NO_MATCH = "Known", "Heuristic", "NoMatch"

# Exploded form of a mapping: one row per header.
MAPPING_SCHEMA = "data_type string, file string, position int, header string, canonical string"


def match_headers(headers: DataFrame, header: str = "header") -> DataFrame:
    """Add ``canonical`` and ``tier`` to every row of ``headers``.

    ERP field codes win over plain-English synonyms. Both lists are fixed (12 codes, 96 synonyms),
    so they are broadcast whatever the number of headers.
    """
    spark = headers.sparkSession
    codes = spark.createDataFrame(list(KNOWN_CODES.items()), "_code string, _known string")
    words = spark.createDataFrame(
        [(word, field) for field, synonyms in SYNONYMS.items() for word in synonyms],
        "_word string, _synonym string",
    )
    return (
        headers
        .join(F.broadcast(codes), F.upper(strip_space(F.col(header))) == F.col("_code"), "left")
        .join(F.broadcast(words), normalize_header(F.col(header)) == F.col("_word"), "left")
        .withColumns({
            "canonical": F.coalesce("_known", "_synonym"),
            "tier": F.when(F.col("_known").isNotNull(), KNOWN)
            .when(F.col("_synonym").isNotNull(), HEURISTIC)
            .otherwise(NO_MATCH),
        })
        .drop("_code", "_known", "_word", "_synonym")
    )


def match_coverage(matches: DataFrame, by: str | Sequence[str] = "file") -> DataFrame:
    """Headers in total and matched, per file."""
    by = [by] if isinstance(by, str) else list(by)
    return matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("headers_total"), F.count("canonical").alias("headers_matched")
    )


def upsert_mapping(old: DataFrame, new: DataFrame, key: str | Sequence[str] = "data_type") -> DataFrame:
    """Replace the entries whose key occurs in ``new`` and keep all others.

    The keys of ``new`` are made distinct first, so one key repeated in many rows is a single row
    in the anti join.
    """
    key = [key] if isinstance(key, str) else list(key)
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    return kept.select(*new.columns).unionByName(new)


def missing_types(
    mapping: DataFrame, by: Sequence[str] = (), required: Sequence[str] = REQUIRED_TYPES
) -> DataFrame:
    """Required data types without an entry, one row each; per group when ``by`` names columns.

    A group is compared through the set of its types, of which there are only a few, so a group's
    size does not matter. An empty mapping without ``by`` lacks every type.
    """
    wanted = F.array(*(F.lit(t) for t in required))
    relevant = F.when(F.col("data_type").isin(list(required)), F.col("data_type"))
    present = F.collect_set(relevant)
    return (
        mapping.groupBy(*by).agg(F.array_except(wanted, present).alias("_missing"))
        .select(*by, F.explode("_missing").alias("data_type"))
    )


def apply_mapping(df: DataFrame, mapping: Mapping[str, str | None] | Sequence[tuple[str, str | None]]) -> DataFrame:
    """Rename headers to their canonical names; columns without an entry pass through.

    An entry is skipped when its canonical name is empty, equals the header, or the header is not
    in ``df``. Two columns that would end up with one name raise ``ContractError``.
    """
    pairs = mapping.items() if isinstance(mapping, Mapping) else mapping
    renames = {h: c for h, c in pairs if c and h != c and h in df.columns}
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        sources.setdefault(renames.get(column, column), []).append(column)
    clashes = [f"{' and '.join(olds)} -> {name}" for name, olds in sources.items() if len(olds) > 1]
    if clashes:
        raise ContractError("several columns map to one name: " + "; ".join(clashes))
    return df.withColumnsRenamed(renames)
