"""Relations that the registered queries analyse, stated once in SQL that Spark and DuckDB both run.

`spark_relation` gives a DataFrame, `duck_cte` the same text as a common table expression. Names in braces
are tables; words that start with @ are spelled differently by the two engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidechart.operators.materialize import materialized
from tidechart.operators.ranking import ranked

#: Orders that one task keeps while it reads their lines.
ORDERS_A_PART = 50_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SPARK_WORDS = {"@epoch_us(": "unix_micros(", "@ts(": "timestamp(", "@double": "DOUBLE"}
DUCK_WORDS = {"@epoch_us(": "epoch_us(", "@ts(": "(", "@double": "DOUBLE"}

RELATIONS = {
    # a chart is a market segment and a return flag; a snapshot is a month; items are parts
    "chart_entries": """
        SELECT chart_id, source, snapshot_id, month_no, item, CAST(rnk AS INT) AS rank, CAST(least(50, n) AS INT) AS chart_size,
               metric_value, CAST(CASE WHEN before_month = month_no - 1 AND before_rnk <= 50 THEN before_rnk END AS INT) AS previous_rank
        FROM (SELECT *, lag(month_no) OVER (PARTITION BY chart_id, item ORDER BY month_no) AS before_month,
                     lag(rnk) OVER (PARTITION BY chart_id, item ORDER BY month_no) AS before_rnk FROM {ranked_parts}) g
        WHERE rnk <= 50""",
    "ranked_parts": """
        SELECT chart_id, source, snapshot_id, month_no, item, metric_value,
               row_number() OVER (PARTITION BY chart_id, month_no ORDER BY metric_value DESC, item) AS rnk,
               count(*) OVER (PARTITION BY chart_id, month_no) AS n
        FROM (SELECT concat(c_mktsegment, '|', l_returnflag) AS chart_id, c_mktsegment AS source,
                     concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS snapshot_id,
                     CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_no, l_partkey AS item,
                     round(sum(l_extendedprice * (1 - l_discount)), 4) AS metric_value
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
              GROUP BY 1, 2, 3, 4, 5) t""",
    "chart_weights": """
        SELECT DISTINCT concat(c_mktsegment, '|', f.flag) AS chart_id, f.weight AS chart_weight
        FROM {customer}, (SELECT 'R' AS flag, CAST(1.0 AS @double) AS weight UNION ALL SELECT 'A', CAST(0.7 AS @double)) f""",
    "country_charts": """
        SELECT country, period, item, CAST(row_number() OVER (PARTITION BY country, period ORDER BY metric_value DESC, item) AS INT) AS rank,
               CAST(count(*) OVER (PARTITION BY country, period) AS INT) AS chart_size, metric_value
        FROM (SELECT n_name AS country, CAST(year(o_orderdate) AS STRING) AS period, l_partkey AS item,
                     round(sum(l_extendedprice * (1 - l_discount)), 4) AS metric_value
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
              GROUP BY 1, 2, 3) t""",
    "listens": """
        SELECT event_id, user_id, n_name AS region, r_name AS macro, concat('k', regexp_extract(props, '[0-9]+', 0)) AS item,
               CASE WHEN event_type IN ('view', 'click') THEN 'play' WHEN event_type = 'purchase' THEN 'like'
                    WHEN event_type = 'error' THEN 'skip' ELSE 'other' END AS action,
               event_type AS source, @ts(ts) AS ts, CAST(floor(@epoch_us(@ts(ts)) / 1000) AS BIGINT) AS ts_ms
        FROM {events} JOIN {nation} ON n_nationkey = user_id % 25 JOIN {region} ON n_regionkey = r_regionkey""",
    "items": """
        SELECT p_partkey AS item, p_name AS title, p_brand AS artist, p_type AS genre, p_size AS size FROM {part}""",
    "trend_obs": """
        SELECT fine, coarse, item, CAST(share AS @double) AS share, max(CASE WHEN is_anchor THEN share END) OVER (PARTITION BY fine) AS anchor_share,
               share > 0 AS has_data, is_anchor, fine_weight
        FROM (SELECT s.*, s.item = a.anchor AS is_anchor, w.fine_weight
              FROM {shares} s
              CROSS JOIN (SELECT item AS anchor FROM {shares} GROUP BY item ORDER BY count(*) DESC, item LIMIT 1) a
              JOIN (SELECT n_name AS fine, CAST(count(*) AS @double) AS fine_weight FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name) w
                ON w.fine = s.fine) t""",
    "shares": """
        SELECT n_name AS fine, r_name AS coarse, l_partkey AS item, sum(l_quantity) AS share
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3""",
    "baskets": """
        SELECT concat('o:', CAST(l_orderkey AS STRING)) AS basket, l_partkey AS item, CAST(min(l_linenumber) AS BIGINT) AS position, CAST(1.0 AS @double) AS w
        FROM {lineitem} GROUP BY 1, 2
        UNION ALL
        SELECT concat('c:', chart_id, '|', snapshot_id), item, CAST(rank AS BIGINT), CAST(0.3 AS @double) FROM {chart_entries}""",
    "sessions": """
        SELECT basket, item, min(ts_ms) AS position, CAST(1.0 AS @double) AS w
        FROM (SELECT concat('s:', CAST(user_id AS STRING), '|', CAST(CAST(floor(ts_ms / 10800000.0) AS BIGINT) AS STRING)) AS basket, item, ts_ms
              FROM {listens} WHERE action IN ('play', 'like')) t GROUP BY 1, 2""",
    "posts": """
        SELECT concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS post_id, CAST(conv_id AS STRING) AS author, role, text FROM {conversations}""",
}


def _names(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text whose names in braces are tables or relations."""
    for word, spelled in SPARK_WORDS.items():
        sql = sql.replace(word, spelled)
    frames = {n: spark_relation(spark, sf_dir, n, known) for n in dict.fromkeys(_names(sql))}
    return spark.sql(sql, **frames)


def _sold(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame]) -> DataFrame:
    """Lines with what their order and customer say, joined and written once. Orders meet customers before the lines, which are many more."""
    bought = """
        SELECT o_orderkey, o_custkey, o_orderpriority, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_no, c_mktsegment, c_nationkey
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
    lines = spark_sql(spark, sf_dir, "SELECT l_orderkey, l_partkey AS item, l_returnflag, l_extendedprice * (1 - l_discount) AS revenue FROM {lineitem}", known)
    # a part's orders are few whatever their number, so they are hashed and the lines need no sort
    parts = max(1, -(-spark_relation(spark, sf_dir, "orders", known).count() // ORDERS_A_PART))
    own = spark_sql(spark, sf_dir, bought, known).repartition(parts, "o_orderkey").hint("shuffle_hash")
    return materialized(lines.repartition(parts, "l_orderkey").join(own, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey"), "sold")


def _chart_entries(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame]) -> DataFrame:
    """Only the first 50 of a snapshot are kept before their former ranks and sizes are told: both hang on no other row."""
    top = """
        SELECT chart_id, source, month_no, item, metric_value, rnk
        FROM (SELECT *, row_number() OVER (PARTITION BY chart_id, month_no ORDER BY metric_value DESC, item) AS rnk
              FROM (SELECT concat(c_mktsegment, '|', l_returnflag) AS chart_id, c_mktsegment AS source,
                           CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_no, l_partkey AS item,
                           round(sum(l_extendedprice * (1 - l_discount)), 4) AS metric_value
                    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
                    GROUP BY 1, 2, 3, 4) t) r
        WHERE rnk <= 50"""
    return _entries(materialized(spark_sql(spark, sf_dir, top, known), "charts"))


#: The name of a month.
SNAPSHOT = "concat(CAST((month_no - 1) DIV 12 AS STRING), '-', lpad(CAST((month_no - 1) % 12 + 1 AS STRING), 2, '0'))"


def _entries(first: DataFrame) -> DataFrame:
    """Chart entries from the first 50 rows of snapshots."""
    return first.sparkSession.sql(
        f"""
        SELECT chart_id, source, {SNAPSHOT} AS snapshot_id, month_no, item, CAST(rnk AS INT) AS rank, CAST(count(*) OVER (PARTITION BY chart_id, month_no) AS INT) AS chart_size, metric_value,
               CAST(CASE WHEN lag(month_no) OVER (PARTITION BY chart_id, item ORDER BY month_no) = month_no - 1
                         THEN lag(rnk) OVER (PARTITION BY chart_id, item ORDER BY month_no) END AS INT) AS previous_rank
        FROM {{first}}""",
        first=first,
    )


def _latest_entries(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame]) -> DataFrame:
    """The entries of each chart's latest snapshot: no others tell them but those of the month before, for former ranks."""
    sold = spark_relation(spark, sf_dir, "sold", known)
    months = """
        SELECT *, max(snapshot_id) OVER (PARTITION BY chart_id) AS last, max_by(month_no, snapshot_id) OVER (PARTITION BY chart_id) AS last_no
        FROM (SELECT *, concat(c_mktsegment, '|', l_returnflag) AS chart_id, SNAPSHOT AS snapshot_id FROM (SELECT DISTINCT c_mktsegment, l_returnflag, month_no FROM {sold}) d) m"""
    # a row or two for each chart
    told = materialized(spark.sql(months.replace("SNAPSHOT", SNAPSHOT), sold=sold).where("month_no IN (last_no, last_no - 1)"), "months")
    top = """
        SELECT chart_id, source, month_no, item, metric_value, rnk
        FROM (SELECT *, row_number() OVER (PARTITION BY chart_id, month_no ORDER BY metric_value DESC, item) AS rnk
              FROM (SELECT chart_id, c_mktsegment AS source, month_no, item, round(sum(revenue), 4) AS metric_value FROM {near} GROUP BY 1, 2, 3, 4) t) r
        WHERE rnk <= 50"""
    near = sold.join(F.broadcast(told), ["month_no", "c_mktsegment", "l_returnflag"])
    entries = _entries(materialized(spark.sql(top, near=near), "charts"))
    return entries.join(F.broadcast(told.select("chart_id", "snapshot_id").where("snapshot_id = last")), ["chart_id", "snapshot_id"], "left_semi")


def _country_charts(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame]) -> DataFrame:
    """Countries and years are few and their charts long, so ranks are counted by ranges."""
    sums = """
        SELECT n_name AS country, CAST(year(o_orderdate) AS STRING) AS period, l_partkey AS item,
               round(sum(l_extendedprice * (1 - l_discount)), 4) AS metric_value
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3"""
    own = ranked(spark_sql(spark, sf_dir, sums, known), ["country", "period"], [F.desc("metric_value"), F.col("item")], "rank", "chart_size")
    return materialized(own.select("country", "period", "item", "rank", "chart_size", "metric_value"), "charts")


def _trend_obs(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame]) -> DataFrame:
    """The shares of the anchor are a row for each fine region; no window holds a region."""
    # regions go by number until they are summed; the rows of an item lie together, so counts by item are small before they are sent
    places = materialized(spark_sql(spark, sf_dir, "SELECT n_nationkey, n_name AS fine, r_name AS coarse, min(n_nationkey) OVER (PARTITION BY n_name, r_name) AS place FROM {nation} JOIN {region} ON n_regionkey = r_regionkey", known), "places")
    numbered = "SELECT l_partkey AS item, place, sum(l_quantity) AS share FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {places} ON s_nationkey = n_nationkey GROUP BY 1, 2"
    sums = spark_sql(spark, sf_dir, numbered, {**known, "places": places}).repartition("item")
    shares = materialized(sums.join(F.broadcast(places.select("place", "fine", "coarse").distinct()), "place").select("fine", "coarse", "item", "share"), "shares")
    # one row
    anchor = shares.groupBy(F.col("item").alias("anchor")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(1).select("anchor")
    weights = spark_sql(spark, sf_dir, "SELECT n_name AS fine, CAST(count(*) AS @double) AS fine_weight FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", known)
    told = shares.crossJoin(F.broadcast(anchor)).withColumn("is_anchor", F.col("item") == F.col("anchor"))
    at_anchor = told.where("is_anchor").groupBy("fine").agg(F.max("share").alias("anchor_share"))
    # a row for each fine region
    own = told.join(F.broadcast(weights.join(at_anchor, "fine", "left")), "fine")
    return own.select("fine", "coarse", "item", F.col("share").cast("double").alias("share"), "anchor_share", (F.col("share") > 0).alias("has_data"), "is_anchor", "fine_weight")


#: Relations that Spark makes in a form of its own, with the rows of the text above, or that only Spark reads.
BUILT = {"sold": _sold, "chart_entries": _chart_entries, "latest_entries": _latest_entries, "country_charts": _country_charts, "trend_obs": _trend_obs}


def spark_relation(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table or relation. known: those that are built already, by name; new ones are put there."""
    known = {} if known is None else known
    if name not in known:
        if name in TABLES:
            known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            known[name] = BUILT[name](spark, sf_dir, known) if name in BUILT else spark_sql(spark, sf_dir, RELATIONS[name], known)
    return known[name]


def duck(sql: str) -> str:
    """SQL for DuckDB: every relation that the text needs becomes a common table expression before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(_names(text)):
            if name in RELATIONS and name not in order:
                need(RELATIONS[name])
                order.append(name)

    need(sql)
    ctes = [f"{n} AS ({RELATIONS[n]})" for n in order]
    body = sql.strip()
    if ctes:
        word = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
        body = f"{word or 'WITH '}{', '.join(ctes)}" + (f", {body[len(word):]}" if word else f" {body}")
    for word, spelled in DUCK_WORDS.items():
        body = body.replace(word, spelled)
    return re.sub(r"\{(\w+)\}", r"\1", body)
