import pytest

from ledgerlift.operators.mapping import (
    MAPPING_SCHEMA, apply_mapping, match_coverage, match_headers, missing_types, upsert_mapping,
)
from ledgerlift.schemas import PRESET_SAP, REQUIRED_TYPES, ContractError
from ledgerlift.sources.bronze import extract_headers
from ledgerlift.sources.layers import confirm_mapping, load_mapping, mapping_document, parse_mapping

KNOWN = {
    "VBELN": "order_id", "KUNNR": "customer_id", "MATNR": "material_id", "NETWR": "net_value", "WAERK": "currency",
    "VKORG": "sales_org", "GJAHR": "fiscal_year", "Vbeln": "order_id", "\tMatnr ": "material_id",
}
HEURISTIC = {
    "SALES-ORG": "sales_org", "fiscal.year": "fiscal_year", "Sku": "material_id", "part__number": "material_id",
    "distribution channel ": "distribution_channel", "DAYS LATE": "days_late", "freight-cost": "freight_cost_usd",
    "Customer name": "customer_id", "order number": "order_id",
}
NO_MATCH = ["Q9-LAGER", "remark", "ledger_note", "f7", "--", ""]


def test_match_headers(spark):
    headers = [*KNOWN, *HEURISTIC, *NO_MATCH]
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate(headers)], "file string, position int, header string")
    found = {r["header"]: (r["canonical"], r["tier"]) for r in match_headers(df).collect()}
    expected = {h: (c, "Known") for h, c in KNOWN.items()} | {h: (c, "Heuristic") for h, c in HEURISTIC.items()}
    assert found == expected | {h: (None, "NoMatch") for h in NO_MATCH}
    coverage = match_coverage(match_headers(df)).first()
    assert (coverage["headers_total"], coverage["headers_matched"]) == (len(headers), len(KNOWN) + len(HEURISTIC))


@pytest.mark.parametrize("scan", [False, True])
def test_headers_of_a_folder_of_exports(spark, tmp_path, scan):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfVBELN,KUNNR,MATNR,Remark\r\n0815,K-77,M-5,late\r\n")
    (tmp_path / "sub" / "b.csv").write_text('"Order Number", ,SKU')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "wide.csv").write_text(",".join(f"column_number_{i}" for i in range(9000)) + "\n1,2\n")
    (tmp_path / "notes.txt").write_text("not,an,export")
    found = extract_headers(spark, str(tmp_path), scan=scan).collect()
    names = {}
    for r in sorted(found, key=lambda r: r["position"]):
        names.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["header"])
    assert names.pop("wide.csv") == [f"column_number_{i}" for i in range(9000)]
    assert names == {"a.csv": ["VBELN", "KUNNR", "MATNR", "Remark"], "b.csv": ["Order Number", "SKU"]}
    matched = {r["header"]: r["tier"] for r in match_headers(extract_headers(spark, str(tmp_path / "a.csv"))).collect()}
    assert matched == {"VBELN": "Known", "KUNNR": "Known", "MATNR": "Known", "Remark": "NoMatch"}


def mapping(spark, *rows):
    return spark.createDataFrame(list(rows), MAPPING_SCHEMA)


def test_upsert_replaces_one_type(spark, rows):
    old = mapping(spark, ("sales_header", "h.csv", 0, "A", "order_id"), ("delivery", "d.csv", 0, "B", "route"),
                  ("sales_header", "h.csv", 1, "C", None))
    new = mapping(spark, ("sales_header", "h2.csv", 0, "X", "order_id"))
    assert sorted(rows(upsert_mapping(old, new))) == [
        ("delivery", "d.csv", 0, "B", "route"), ("sales_header", "h2.csv", 0, "X", "order_id"),
    ]


def test_missing_types(spark, rows):
    full = mapping(spark, *((t, "f", 0, "H", None) for t in REQUIRED_TYPES))
    assert rows(missing_types(full)) == []
    assert rows(missing_types(full.where("data_type <> 'delivery'"))) == [("delivery",)]
    assert sorted(rows(missing_types(mapping(spark)))) == sorted((t,) for t in REQUIRED_TYPES)


def test_apply_mapping(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "VBELN string, same string, keep string, other string")
    renamed = apply_mapping(df, [("VBELN", "order_id"), ("same", "same"), ("keep", None), ("gone", "route"), ("other", "")])
    assert renamed.columns == ["order_id", "same", "keep", "other"]


@pytest.mark.parametrize("pairs", [
    [("SKU", "material_id"), ("Part Number", "material_id")], [("SKU", "Part Number")],
])
def test_apply_mapping_refuses_collisions(spark, pairs):
    df = spark.createDataFrame([("1", "2")], "SKU string, `Part Number` string")
    with pytest.raises(ContractError, match="SKU and Part Number"):
        apply_mapping(df, pairs)


def test_native_preset_covers_all_types():
    assert set(PRESET_SAP) == {*REQUIRED_TYPES, "material_master"}


def test_confirm_mapping_keeps_other_types(spark, tmp_path, rows):
    config = str(tmp_path)
    assert load_mapping(spark, config) is None
    confirm_mapping(spark, config, "delivery", "dlv.csv", [("ROUTE", "route")])
    pairs = [("VBELN", "order_id"), ("ZZZ", None), ("KUNNR", "customer_id")]
    confirm_mapping(spark, config, "sales_header", "hdr.csv", [("OLD", "order_id")])
    confirm_mapping(spark, config, "sales_header", "hdr.csv", pairs)
    assert sorted(rows(load_mapping(spark, config))) == [
        ("delivery", "dlv.csv", 0, "ROUTE", "route"),
        *[("sales_header", "hdr.csv", i, h, c) for i, (h, c) in enumerate(pairs)],
    ]


def test_config_written_elsewhere_is_read_and_a_broken_one_is_empty(spark, tmp_path, rows):
    file = tmp_path / "field_mapping.json"
    file.write_text('{\n "delivery": {"file": "d.csv",\n  "mapping": [{"header": "R", "canonical": "route"}, {"header": "X", "canonical": null}]},\n "other": {"file": "o.csv", "mapping": []}\n}')
    assert sorted(rows(load_mapping(spark, str(tmp_path))), key=str) == [
        ("delivery", "d.csv", 0, "R", "route"), ("delivery", "d.csv", 1, "X", None), ("other", "o.csv", None, None, None),
    ]
    other = tmp_path / "broken"
    other.mkdir()
    (other / "field_mapping.json").write_text("not json {")
    assert rows(load_mapping(spark, str(other))) == []
    confirm_mapping(spark, str(tmp_path), "delivery", "e.csv", [])
    assert sorted(rows(load_mapping(spark, str(tmp_path))), key=str) == [
        ("delivery", "e.csv", None, None, None), ("other", "o.csv", None, None, None),
    ]


def test_documents_per_group(spark, rows):
    df = spark.createDataFrame(
        [("t1", "delivery", "d.csv", 1, "B", None), ("t1", "delivery", "d.csv", 0, "A", "route"), ("t2", "x", "x.csv", 0, "C", "c")],
        f"tenant string, {MAPPING_SCHEMA}",
    )
    documents = mapping_document(df, ["tenant"])
    assert documents.count() == 2
    assert sorted(rows(parse_mapping(documents, keep=["tenant"]))) == sorted(rows(df))
