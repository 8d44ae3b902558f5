"""Rows from captured pages and payloads, by expressions over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidechart.functions.scoring import previous_rank


def extract_page_rows(pages: DataFrame, key: str, html: str, row_re: str, fields: dict[str, str]) -> DataFrame:
    """key, row_no from 1, and a column for each field: the first group of its pattern in each row."""
    rows = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(row_re), F.lit(0))
    each = pages.select(key, F.posexplode(rows).alias("at", "row"))
    return each.select(key, (F.col("at") + 1).alias("row_no"), *[F.regexp_extract("row", pattern, 1).alias(name) for name, pattern in fields.items()])


def with_previous_rank(rows: DataFrame, rank: str, move: str) -> DataFrame:
    return rows.withColumn("previous_rank", previous_rank(F.col(rank), F.col(move)))


def extract_embedded_json(pages: DataFrame, key: str, html: str, var: str, schema: str, ok: Column | None = None) -> DataFrame:
    """Elements of the JSON array that a page's script assigns to `var`, those for which `ok` holds."""
    body = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), rf"(?s)\b{var}\s*=\s*(\[.*?\])\s*;", 1)
    each = pages.select(key, F.posexplode_outer(F.from_json(body, f"array<{schema}>")).alias("at", "e")).where("e is not null").select(key, (F.col("at") + 1).alias("row_no"), "e.*")
    return each.where(ok) if ok is not None else each


def explode_trend_payload(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, geo_code, geo_name, query_no, value, has_data of search-interest payloads: regions with a value for each query.

    The payload may start with a guard line. value is null where the region has no data.
    """
    kind = "struct<default:struct<geoMapData:array<struct<geoCode:string,geoName:string,value:array<int>,hasData:array<boolean>>>>>"
    body = F.regexp_replace(F.col(payload), r"^\)\]\}'?,?\s*", "")
    regions = df.select(key, F.explode(F.from_json(body, kind)["default"]["geoMapData"]).alias("g"))
    each = regions.select(key, F.col("g.geoCode").alias("geo_code"), F.col("g.geoName").alias("geo_name"), F.posexplode(F.arrays_zip(F.col("g.value").alias("value"), F.col("g.hasData").alias("has"))).alias("query_no", "z"))
    return each.select(key, "geo_code", "geo_name", "query_no", F.when(F.col("z.has"), F.col("z.value")).alias("value"), F.coalesce("z.has", F.lit(False)).alias("has_data"))


#: Letters of product types in sale feeds.
PRODUCT_TYPES = {"a": "album", "t": "track", "p": "package", "b": "bundle"}


def flatten_sales(df: DataFrame, payload: str) -> DataFrame:
    """One row for each item of each sale event, with its time and a fingerprint of six fields."""
    item = "struct<item_type:string,item_description:string,artist_name:string,country_code:string,amount_paid:double,url:string>"
    events = df.select(F.explode(F.from_json(payload, f"struct<events:array<struct<utc_date:double,items:array<{item}>>>>")["events"]).alias("e"))
    rows = events.select(F.col("e.utc_date").alias("utc_date"), F.explode("e.items").alias("i")).select("utc_date", "i.*")
    kind = F.lit("other")
    for letter, name in PRODUCT_TYPES.items():
        kind = F.when(F.col("item_type") == letter, name).otherwise(kind)
    mark = F.sha2(F.to_json(F.struct("utc_date", "item_type", "item_description", "artist_name", "country_code", "url")), 256)
    return rows.select(F.timestamp_seconds("utc_date").alias("sold_at"), kind.alias("product"), "item_description", "artist_name", "country_code", "amount_paid", "url", mark.alias("fingerprint"))
