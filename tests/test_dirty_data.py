"""Registered queries on a copy of the tables with nulls, zeros, hot keys and copies.

A third of the lines belong to one order, a third of the orders to one customer, a third of the
documents and vectors are copies.
"""

import shutil
from pathlib import Path

import duckdb
import pytest

from test_queries import QUERIES, SQL, TABLES, canonical

CHANGES = {
    "lineitem": """select * replace (
        case when hash(l_partkey, l_extendedprice, 1) % 3 = 0 then 7
          when hash(l_partkey, l_extendedprice, 1) % 50 = 1 then null else l_orderkey end as l_orderkey,
        case when hash(l_orderkey, l_partkey, 2) % 40 = 0 then null
          when hash(l_orderkey, l_partkey, 2) % 3 = 1 then 10 else l_partkey end as l_partkey,
        case hash(l_orderkey, l_partkey, 3) % 40 when 0 then null when 1 then 0.0 else l_extendedprice end as l_extendedprice,
        case hash(l_orderkey, l_partkey, 4) % 40 when 0 then null when 1 then 1.0 else l_discount end as l_discount,
        case when hash(l_orderkey, l_partkey, 5) % 40 = 0 then null else l_returnflag end as l_returnflag,
        case when hash(l_orderkey, l_partkey, 6) % 40 = 0 then null else l_suppkey end as l_suppkey,
        case when hash(l_orderkey, l_partkey, 7) % 40 = 0 then null else l_shipdate end as l_shipdate,
        case when hash(l_orderkey, l_partkey, 8) % 40 = 0 then null else l_quantity end as l_quantity,
        case when hash(l_orderkey, l_partkey, 9) % 40 = 0 then null else l_linenumber end as l_linenumber) from {src}""",
    "orders": """select * replace (
        case when o_orderkey % 3 = 0 then 5 when o_orderkey % 50 = 1 then null when o_orderkey % 50 = 2 then 99999999
          else o_custkey end as o_custkey,
        case when o_orderkey % 30 = 1 then null else o_orderpriority end as o_orderpriority) from {src}
        union all select * from {src} where o_orderkey % 100 = 4""",
    "customer": "select * replace (case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment) from {src} where c_custkey <> 13",
    "part": "select * replace (case when p_partkey % 9 = 0 then null else p_brand end as p_brand) from {src}",
    "documents": """select * replace (case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then ''
        when doc_id % 3 = 0 then (select text from {src} order by doc_id limit 1) else text end as text) from {src}""",
    "embeddings": """select * replace (case when vec_id % 3 = 0 then (select embedding from {src} where vec_id = 3)
        else embedding end as embedding) from {src}""",
}
NAMES = (
    "sales_enriched margin_by_material margin_by_segment margins_by_cut budget_variance delivery_performance "
    "validate_sales validate_controlling validate_delivery extract_headers match_headers match_coverage upsert_mapping "
    "missing_types load_mapping insights_all budget_context gold_context knn_l2 knn_join_l2 knn_join_cosine "
    "knn_join_blocks embed_texts semantic_search read_bronze land_bronze metric_json"
).split()


@pytest.fixture(scope="module")
def dirty(tmp_path_factory, sf_dir):
    folder = tmp_path_factory.mktemp("dirty")
    connection = duckdb.connect()
    for table in TABLES:
        source = Path(sf_dir) / f"{table}.parquet"
        if table in CHANGES:
            query = CHANGES[table].format(src=f"'{source}'")
            connection.execute(f"copy ({query}) to '{folder}/{table}.parquet' (format parquet)")
        else:
            shutil.copy(source, folder)
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return str(folder), connection


def nine_digits(rows):
    return [tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("name", NAMES)
def test_query_on_dirty_data(spark, dirty, name):
    folder, connection = dirty
    df = QUERIES[name](spark, folder)
    result = connection.execute(SQL[name])
    columns = [c[0] for c in result.description]
    found = canonical(df.columns, nine_digits(df.collect()))
    assert found and found == canonical(columns, nine_digits(result.fetchall()))
