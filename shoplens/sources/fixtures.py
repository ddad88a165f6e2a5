"""Logical views over the driver's test tables.

The reference works on a product catalog and a user event log; the test data
is a TPC-H-like star schema plus a generic event table. These views rename
and re-type columns (a fixture convention, not semantics). Each view exists
twice: as a Spark DataFrame builder and as the DuckDB SQL used by the oracle.
Both must stay written the same way.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _session_defaults(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session_defaults(spark: SparkSession) -> None:
    """Queries may receive a session built elsewhere: pin the settings results depend on."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    from shoplens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, name)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        (size % 4 != 0).alias("in_stock"),
        F.when(size % 3 == 0, F.lit("men")).when(size % 3 == 1, F.lit("women")).alias("gender"),
    )


def _event_type(raw: Column) -> Column:
    return (F.when(raw == "signup", F.lit("add_to_cart"))
            .when(raw == "error", F.lit("time_spent"))
            .otherwise(raw))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from(_read(spark, sf_dir, "events"))


def events_from(e: DataFrame) -> DataFrame:
    """The events view over any raw events frame (batch or streaming)."""
    return e.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _event_type(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("time_spent_seconds"),
    )


def rank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the ranker's vocabulary (no time_spent rows)."""
    return events(spark, sf_dir).where(F.col("event_type") != "time_spent")


def big_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders as an event log with many items and users (scale view)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    flag = F.col("l_returnflag")
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(flag == "N", F.lit("purchase")).when(flag == "A", F.lit("add_to_cart"))
        .otherwise(F.lit("click")).alias("event_type"),
        F.lit(None).cast("double").alias("time_spent_seconds"),
    )


def image_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("item_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def text_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text vector of item i = image vector of item (i+1) mod n."""
    e = _read(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()
    src = e.select(F.col("vec_id").alias("src_id"), "embedding")
    keys = e.select(F.col("vec_id"), F.pmod(F.col("vec_id") + 1, n).alias("src_id"))
    return keys.join(src, "src_id").select(
        F.col("vec_id").cast("string").alias("item_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def carts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open carts: add_to_cart events per (user, item), quantity = count."""
    ev = events(spark, sf_dir).where(F.col("event_type") == "add_to_cart")
    return ev.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).alias("quantity"), F.min("ts").alias("created_at"))


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL (oracle side). Keep in step with the builders.
# ---------------------------------------------------------------------------

VIEW_SQL = {
    "products": """
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS product_name, p_type AS category,
       p_brand AS brand, p_retailprice AS price, (p_size % 4 <> 0) AS in_stock,
       CASE WHEN p_size % 3 = 0 THEN 'men' WHEN p_size % 3 = 1 THEN 'women' END AS gender
FROM part""",
    "ev": """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
       ts,
       CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'time_spent'
            ELSE event_type END AS event_type,
       CASE WHEN event_type = 'error' THEN value END AS time_spent_seconds
FROM events""",
    "rev": "SELECT * FROM ev WHERE event_type <> 'time_spent'",
    "bev": """
SELECT l_orderkey * 8 + l_linenumber AS event_id, CAST(o_custkey AS VARCHAR) AS user_id,
       CAST(l_partkey AS VARCHAR) AS item_id, l_shipdate AS ts,
       CASE l_returnflag WHEN 'N' THEN 'purchase' WHEN 'A' THEN 'add_to_cart' ELSE 'click' END
         AS event_type,
       CAST(NULL AS DOUBLE) AS time_spent_seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "image_emb": "SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "text_emb": """
SELECT CAST(k.vec_id AS VARCHAR) AS item_id, CAST(s.embedding AS DOUBLE[]) AS embedding
FROM embeddings k JOIN embeddings s
  ON s.vec_id = (k.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
    "carts": """
SELECT user_id, item_id, count(*) AS quantity, min(ts) AS created_at
FROM ev WHERE event_type = 'add_to_cart' GROUP BY user_id, item_id""",
}

# view -> views it reads (so a prelude lists dependencies first)
_VIEW_DEPS = {"rev": ["ev"], "carts": ["ev"]}


def _ordered(views) -> list[str]:
    out: list[str] = []

    def visit(v):
        for d in _VIEW_DEPS.get(v, []):
            visit(d)
        if v not in out:
            out.append(v)

    for v in views:
        visit(v)
    return out


def with_views(views, body: str, ctes: str | None = None) -> str:
    """Build ``WITH <views>[, <ctes>] <body>`` for the DuckDB oracle."""
    parts = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in _ordered(views)]
    if ctes:
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


@lru_cache(maxsize=None)
def view_names() -> tuple[str, ...]:
    return tuple(VIEW_SQL)
