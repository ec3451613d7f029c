"""ERP tables derived from a TPC-H-like star schema.

Each text is a query over the star tables, named in braces; the same text runs on Spark and on any
ANSI engine, so results can be compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MATERIAL = (
    "case {key} % 5 when 0 then 'MAT-01' when 1 then 'MAT-02' when 2 then 'MAT-03' "
    "when 3 then 'MAT-04' else 'MAT-05' end as material_id"
)
_BUDGET = (
    "l_extendedprice * cast(case when year(l_shipdate) % 2 = 0 then 1.036 else 1.044 end as double)"
)

VIEWS: dict[str, str] = {
    "sales_header": """
        select o_orderkey as order_id, o_custkey as customer_id,
          cast(cast(o_orderdate as date) as varchar(10)) as order_date,
          case o_orderkey % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' else 'JPY' end as currency,
          o_orderpriority as distribution_channel,
          case o_custkey % 3 when 0 then '1000' when 1 then '2000' else '3000' end as sales_org
        from {orders}""",
    "sales_items": f"""
        select l_orderkey as order_id, cast(l_linenumber as bigint) as line_item_number,
          {_MATERIAL.format(key="l_partkey")},
          l_extendedprice * (1 - l_discount) as net_value,
          l_extendedprice * cast(case l_partkey % 5 when 0 then 0.98 when 1 then 0.94 when 2 then 0.85
            when 3 then 0.72 else 0.60 end as double) as estimated_cost
        from {{lineitem}}""",
    "customer_master": """
        select c_custkey as customer_id, c_mktsegment as industry, r_name as region_group,
          c_custkey as row_no
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "material_master": f"""
        select {_MATERIAL.format(key="p_partkey")},
          p_name as material_description, p_type as material_group, p_brand as manufacturer, p_partkey as row_no
        from {{part}}""",
    "controlling": f"""
        select l_orderkey as order_id, p_brand as department, cast(year(l_shipdate) as bigint) as fiscal_year,
          l_extendedprice * (1 + l_tax) as actual_cost,
          {_BUDGET} as budget_amount,
          l_extendedprice * (1 + l_tax) - {_BUDGET} as budget_variance
        from {{lineitem}} join {{part}} on l_partkey = p_partkey""",
    "delivery": """
        select l_orderkey * 10 + l_linenumber as delivery_id,
          case l_suppkey % 5 when 0 then 'R001' when 1 then 'R002' when 2 then 'R003' when 3 then 'R004'
            else 'R005' end as route,
          case l_returnflag when 'A' then 'AIR' when 'N' then 'ROAD' else 'SEA' end as transport_type,
          cast((l_orderkey * 7 + l_linenumber * 3) % 8 + l_suppkey % 5 as double) as days_late,
          l_quantity * cast(12.5 as double) as freight_cost_usd
        from {lineitem}""",
}


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text over the star tables in ``sf_dir``."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in re.findall(r"{(\w+)}", text)}
    return spark.sql(text, **tables)


def erp_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One ERP table. The two masters still hold several rows per key, ordered by ``row_no``."""
    return view(spark, sf_dir, VIEWS[name])


def plain_sql(text: str) -> str:
    """The text with plain table names."""
    return re.sub(r"{(\w+)}", r"\1", text)


# Every order is taken for an export file and its lines for the header cells, in many spellings.
EXPORT_HEADERS = """
    select 'export-' || cast(l_orderkey as varchar(20)) || '.csv' as file, l_linenumber as position,
      case (l_partkey * 7 + l_suppkey) % 32
        when 0 then 'VBELN' when 1 then 'Kunnr' when 2 then ' MATNR' when 3 then 'NETWR' when 4 then 'waerk'
        when 5 then 'VKORG' when 6 then 'GJAHR' when 7 then 'LIFNR' when 8 then 'Order No'
        when 9 then 'order no' when 10 then 'ORDER_NO' when 11 then 'order  number'
        when 12 then 'customer name' when 13 then 'Sku' when 14 then 'part-number'
        when 15 then 'DISTRIBUTION CHANNEL' when 16 then 'days_late' when 17 then 'Freight Cost [USD]'
        when 18 then 'Q9-LAGER' when 19 then 'remark' when 20 then 'ledger_note' when 21 then 'f7'
        when 22 then '--' when 23 then 'Stückzahl' when 24 then 'Fiscal Year.' when 25 then 'Carrier/Route'
        when 26 then 'Budget' when 27 then 'Variance' when 28 then 'Region-Group' when 29 then 'P/O'
        when 30 then 'Cost of Goods' else l_returnflag end as header
    from {lineitem}"""

# Every order is taken for a tenant with mapping entries; rows of origin R are newly confirmed.
MAPPING_ROWS = """
    select l_orderkey as tenant,
      case l_linenumber when 1 then 'sales_header' when 2 then 'sales_items' when 3 then 'customer_master'
        when 4 then 'controlling' when 5 then 'delivery' when 6 then 'material_master' else 'other' end as data_type,
      'file-' || cast(l_linenumber as varchar(10)) || '.csv' as file,
      'H' || cast(l_partkey as varchar(20)) as header,
      case when l_partkey % 3 = 0 then null else 'field_' || cast(l_partkey % 20 as varchar(10)) end as canonical,
      l_returnflag as origin
    from {lineitem}"""

# Every document is taken for an export whose first line is the header.
DOCUMENT_LINES = """
    select doc_id as file, text as line from {documents}"""
