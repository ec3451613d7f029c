"""Table contracts, data types and the fixed lists used to match headers."""

from __future__ import annotations

# Data types a mapping may hold. A run needs every required one.
REQUIRED_TYPES = ("sales_header", "sales_items", "customer_master", "controlling", "delivery")
OPTIONAL_TYPES = ("material_master",)

# Canonical columns that later steps use, per data type.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "sales_header": ("order_id", "customer_id", "currency", "distribution_channel", "sales_org"),
    "sales_items": ("order_id", "material_id", "net_value", "estimated_cost"),
    "customer_master": ("customer_id", "industry", "region_group"),
    "material_master": ("material_id",),
    "controlling": (
        "order_id", "department", "fiscal_year", "actual_cost", "budget_amount", "budget_variance",
    ),
    "delivery": ("delivery_id", "route", "transport_type", "days_late", "freight_cost_usd"),
}

# Measures are doubles. Everything else stays as written, so ids keep leading zeros.
MEASURES = frozenset({
    "net_value", "estimated_cost", "actual_cost", "budget_amount", "budget_variance",
    "days_late", "freight_cost_usd",
})

# Name given to a source row's place in its file; see sources.bronze.
POSITION = "_pos"

# Folder name under which the landing stream keeps its micro-batches; no column of an export.
LANDED_BATCH = "ledgerlift_batch"

# Length of the vectors in the vector table.
EMBEDDING_DIM = 768

# ERP field code -> canonical field.
KNOWN_CODES: dict[str, str] = {
    "VBELN": "order_id",
    "KUNNR": "customer_id",
    "MATNR": "material_id",
    "NETWR": "net_value",
    "WAERK": "currency",
    "VKORG": "sales_org",
    "VTWEG": "distribution_channel",
    "KOSTL": "department",
    "GJAHR": "fiscal_year",
    "ERDAT": "order_date",
    "BUKRS": "company_code",
    "WERKS": "plant",
}

# Canonical field -> plain-English synonyms, already normalised.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "order_id": (
        "order", "ordernumber", "orderid", "orderno", "ponumber", "po", "purchaseorder", "salesorder",
    ),
    "customer_id": (
        "customer", "customername", "customerid", "customernumber", "client", "clientid",
        "account", "accountid", "custid", "custno",
    ),
    "material_id": (
        "material", "materialid", "itemnumber", "item", "sku", "skunumber", "part", "partnumber",
        "product",
    ),
    "net_value": ("amount", "netamount", "netvalue", "salesamount", "revenue", "value", "price"),
    "estimated_cost": ("estimatedcost", "unitcost", "cogs", "costofgoods"),
    "currency": ("currency", "curr", "currencycode"),
    "distribution_channel": ("distributionchannel", "saleschannel", "distchannel", "channel"),
    "sales_org": ("salesorg", "salesorganization"),
    "industry": ("industry", "sector", "industrytype"),
    "region_group": ("regiongroup", "region", "geography", "area"),
    "department": ("department", "dept", "costcenter", "division"),
    "fiscal_year": ("fiscalyear", "fy", "fiscalyr"),
    "actual_cost": ("actualcost", "actuals", "actual", "spend"),
    "budget_amount": ("budgetamount", "budget", "plannedcost", "planned", "plan"),
    "budget_variance": ("budgetvariance", "variance", "var"),
    "route": ("route", "routeid", "shippingroute", "deliveryroute"),
    "transport_type": ("transporttype", "shipmenttype", "carriertype", "transport"),
    "days_late": ("dayslate", "latedays", "delay", "deliverydelay", "lateness"),
    "freight_cost_usd": ("freightcost", "freightcostusd", "freight", "shippingcost", "freightcharge"),
    "delivery_id": ("deliveryid", "deliverynumber", "delivery", "shipmentid", "shipment"),
}

# Columns of the native SAP-style export that have a canonical name.
PRESET_SAP: dict[str, dict[str, str]] = {
    "sales_header": {
        "ssh_order_id": "order_id",
        "ssh_customer_id": "customer_id",
        "ssh_currency": "currency",
        "ssh_distribution_channel": "distribution_channel",
        "ssh_sales_org": "sales_org",
    },
    "sales_items": {
        "ssi_order_id": "order_id",
        "ssi_material_id": "material_id",
        "ssi_net_value": "net_value",
        "ssi_estimated_cost": "estimated_cost",
    },
    "customer_master": {
        "scm_customer_id": "customer_id",
        "scm_industry": "industry",
        "scm_region_group": "region_group",
    },
    "material_master": {"smm_material_id": "material_id"},
    "controlling": {
        "sco_department": "department",
        "sco_fiscal_year": "fiscal_year",
        "sco_actual_cost": "actual_cost",
        "sco_budget_amount": "budget_amount",
        "sco_budget_variance": "budget_variance",
        "sco_order_id": "order_id",
    },
    "delivery": {
        "sdl_route": "route",
        "sdl_transport_type": "transport_type",
        "sdl_days_late": "days_late",
        "sdl_freight_cost_usd": "freight_cost_usd",
        "sdl_delivery_id": "delivery_id",
    },
}

# File names of the native export.
PRESET_SAP_FILES: dict[str, str] = {
    "sales_header": "SAP_Sales_Header.csv",
    "sales_items": "SAP_Sales_Items.csv",
    "customer_master": "SAP_Customer_Master.csv",
    "material_master": "SAP_Material_Master.csv",
    "controlling": "SAP_Controlling.csv",
    "delivery": "SAP_Delivery.csv",
}


class ContractError(ValueError):
    """A table lacks canonical columns, or a mapping cannot be applied."""


def require_columns(df, data_type: str):
    """Return ``df`` unchanged, or raise naming every contract column it lacks."""
    missing = [c for c in CONTRACTS[data_type] if c not in df.columns]
    if missing:
        raise ContractError(f"{data_type} lacks column(s): {', '.join(missing)}")
    return df
