"""Schemas of the logical tables, and a check that a DataFrame carries one.

Identifiers and product codes are strings: they keep leading zeros. Prices in logs are micro-dollars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "search_listing": "session string, click_id string, click_date date, upc string, item_index int, "
    "monetized boolean, relevance_score double, scenario string, component string, text_typed string, "
    "banner string",
    "clickstream": "session string, upc string, click_id string, click_time timestamp, scenario string, component string",
    "transaction": "household_id string, upc string, net_spend double, loyalty_amount double, retail_amount double, "
    "units bigint, trn_dt int, trn_tm string",
    "household": "household_id string, hashed_id string",
    "store": "division string, store string, state string",
    "ad_log": "request_id string, impression_id string, campaign_id string, slot_id string, sku string, "
    "div_store string, unit_type string, clearing_price bigint, matching_target_values array<string>, "
    "count_fill int, log_type string, dt date",
    "opportunity_log": "ad_request_id string, dt string, year string, target string, placement_id string, "
    "slot_id string, keyword string, slots_available int, organic_rank int, paid_rank int",
    "slot": "id string, name string",
    "target_value": "id string, label string",
    "campaign": "id string, start_date date, budget double, status string",
    "product": "upc string, description string, taxonomy string, category string, brand string, "
    "sub_category_code string, sub_category_name string",
    "request_item": "request_id string, query string, sku string, champion_rank int, click int",
    "retrieval": "request_id string, query string, results array<struct<score: double, sku: string>>",
    "keyword_map": "keyword string, matches array<string>",
}


def schema_of(table: str) -> StructType:
    """Schema of a logical table."""
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` to a logical table: every column must exist, text is cast and bad text becomes null.

    The source may hold all columns as strings, as headered CSV and clickstream records do.
    """
    schema = schema_of(table)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(field):
        if types[field.name] == field.dataType:
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
