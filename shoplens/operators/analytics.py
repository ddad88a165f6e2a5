"""Behaviour analytics: filters, event/product joins, KPIs, funnels, facets.

Joins against the catalog are plain equi-joins: Spark broadcasts the catalog
only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``
(AQE re-checks at runtime), otherwise it shuffles both sides on item_id.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.session import cut_lineage


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


# B1 -------------------------------------------------------------------------
def filter_events(events: DataFrame, users: Sequence[str] | None = None,
                  start: str | _dt.date | None = None, end: str | _dt.date | None = None,
                  ts_col: str = "ts") -> DataFrame:
    """Users in ``users`` (empty = all) and ``start <= ts < end + 1 day``.

    Bounds are literals so the predicate reaches the parquet scan.
    """
    out = events
    if users:
        out = out.where(F.col("user_id").isin(list(users)))
    if start is not None:
        out = out.where(F.col(ts_col) >= F.to_timestamp(F.lit(str(start))))
    if end is not None:
        out = out.where(F.col(ts_col) < F.to_timestamp(F.lit(str(end))) + F.expr("INTERVAL 1 DAY"))
    return out


# B2 -------------------------------------------------------------------------
def clamp(value: Column, lo: Column, hi: Column) -> Column:
    """clamp(value, lo, hi): below lo -> lo, above hi -> hi."""
    return F.greatest(lo, F.least(hi, value))


# B3 -------------------------------------------------------------------------
def recent_events(events: DataFrame, days: int, ts_col: str = "ts") -> DataFrame:
    """Events with ts >= (global max ts) - days.

    The cut-off is a scalar subquery: computed once by a partial/final max
    aggregate and then used as a literal in the filter (no join, no driver loop).
    """
    cutoff = events.select(F.max(ts_col)).scalar() - F.make_interval(days=F.lit(days))
    return events.where(F.col(ts_col) >= cutoff)


# B4 -------------------------------------------------------------------------
def in_stock_filter(items: DataFrame, products: DataFrame) -> DataFrame:
    """Drop items whose catalog row says out of stock; unknown items are kept."""
    stock = products.select("item_id", F.col("in_stock").alias("_in_stock"))
    return (items.join(stock, "item_id", "left")
            .where(F.coalesce(F.col("_in_stock"), F.lit(True)))
            .drop("_in_stock"))


# B5 -------------------------------------------------------------------------
def facet_filter(products: DataFrame, categories: Sequence[str], types: Sequence[str] = (),
                 category_col: str = "category", type_col: str = "product_type") -> DataFrame:
    """category in selected AND (no type selected OR type in selected)."""
    cond = F.col(category_col).isin(list(categories))
    if types:
        cond = cond & F.col(type_col).isin(list(types))
    return products.where(cond)


# B6 -------------------------------------------------------------------------
def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "row_no",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total order, without a one-partition window.

    Range-partition + sort, number rows inside each partition, then add the
    running count of all earlier partitions (a table with one row per
    partition, the only thing that is ordered globally).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: rows and offsets must see the same partitions, whatever columns each of them reads
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def global_cumsum(df: DataFrame, order: Sequence[Column], value: Column, name: str,
                  inclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` in a total order, distributed like global_row_number."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.withColumn("_val", value).repartitionByRange(n, *order)
                         .withColumn("_pid", F.spark_partition_id()))
    frame_end = Window.currentRow if inclusive else -1
    local = ranged.withColumn("_local", F.coalesce(F.sum("_val").over(
        Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)),
        F.lit(0)))
    totals = local.groupBy("_pid").agg(F.sum("_val").alias("_n"))
    offsets = totals.select("_pid", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
            .drop("_pid", "_local", "_off", "_val"))


def paginate(df: DataFrame, order: Sequence[Column], page_size: int, page: int) -> DataFrame:
    """Rows of one page plus ``total_pages = max(1, ceil(n / page_size))``.

    A page outside ``1..total_pages`` falls back to page 1.
    """
    numbered = global_row_number(df, order)
    total = numbered.select(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(page_size)))).scalar()
    eff_page = F.when((F.lit(page) >= 1) & (F.lit(page) <= total), F.lit(page)).otherwise(F.lit(1))
    page_of = F.floor((F.col("row_no") - 1) / F.lit(page_size)) + 1
    return (numbered.where(page_of == eff_page)
            .withColumn("page", eff_page.cast("long"))
            .withColumn("total_pages", total.cast("long")))


def page_of_item(df: DataFrame, order: Sequence[Column], page_size: int,
                 key_col: str = "item_id") -> DataFrame:
    """Page number holding each row (used to jump to the page of a target id)."""
    numbered = global_row_number(df, order)
    return numbered.select(key_col, (F.floor((F.col("row_no") - 1) / F.lit(page_size)) + 1)
                           .cast("long").alias("page"))


# See search.substring_lookup for the batched LIKE lookups.

# C1 - C3 ---------------------------------------------------------------------
def events_left_products(events: DataFrame, products: DataFrame) -> DataFrame:
    """Every event with its catalog row (NULL columns when the item is unknown)."""
    return events.join(products, "item_id", "left")


def events_named(events: DataFrame, products: DataFrame) -> DataFrame:
    """Left join + product_name = COALESCE(name, 'Item ' || item_id)."""
    names = products.select("item_id", F.col("product_name").alias("_name"))
    return (events.join(names, "item_id", "left")
            .withColumn("product_name",
                        F.coalesce(F.col("_name"), F.concat(F.lit("Item "), F.col("item_id"))))
            .drop("_name"))


def events_inner_products(events: DataFrame, products: DataFrame) -> DataFrame:
    return events.join(products, "item_id", "inner")


# D1 / D5 --------------------------------------------------------------------
def kpis(events: DataFrame) -> DataFrame:
    """One row: views, clicks, add_to_cart, avg_time, conversion_rate (one pass)."""
    et = F.col("event_type")
    views = F.count_if(et == "view")
    carts = F.count_if(et == "add_to_cart")
    avg_time = F.coalesce(
        F.avg(F.when((et == "time_spent") & F.col("time_spent_seconds").isNotNull(),
                     F.col("time_spent_seconds"))), F.lit(0.0))
    return events.agg(
        views.alias("views"),
        F.count_if(et == "click").alias("clicks"),
        carts.alias("add_to_cart"),
        avg_time.alias("avg_time"),
        F.when(views > 0, carts / views * 100.0).otherwise(F.lit(0.0)).alias("conversion_rate"),
    )


def funnel(events: DataFrame) -> DataFrame:
    """Three rows (stage, count): view -> click -> add_to_cart."""
    k = kpis(events)
    return k.select(F.inline(F.array(
        F.struct(F.lit("view").alias("stage"), F.col("views").alias("count")),
        F.struct(F.lit("click").alias("stage"), F.col("clicks").alias("count")),
        F.struct(F.lit("add_to_cart").alias("stage"), F.col("add_to_cart").alias("count")),
    )))


# D2 - D4 --------------------------------------------------------------------
def product_event_counts(named_events: DataFrame, event_type: str) -> DataFrame:
    return (named_events.where(F.col("event_type") == event_type)
            .groupBy("product_name").agg(F.count(F.lit(1)).alias("count")))


def time_spent_by_product(named_events: DataFrame) -> DataFrame:
    return (named_events
            .where((F.col("event_type") == "time_spent") & F.col("time_spent_seconds").isNotNull())
            .groupBy("product_name")
            .agg(F.avg("time_spent_seconds").alias("avg_time_spent_seconds")))


def conversion_by_product(named_events: DataFrame) -> DataFrame:
    """views, add_to_cart and rate per product (outer-join semantics in one aggregate)."""
    et = F.col("event_type")
    agg = (named_events.where(et.isin("view", "add_to_cart"))
           .groupBy("product_name")
           .agg(F.count_if(et == "view").alias("views"),
                F.count_if(et == "add_to_cart").alias("add_to_cart")))
    return agg.withColumn(
        "conversion_rate_pct",
        F.when(F.col("views") > 0, F.col("add_to_cart") / F.col("views") * 100.0)
        .otherwise(F.lit(0.0)))


# D11 / F1 -------------------------------------------------------------------
def top_popular(events: DataFrame, products: DataFrame, limit: int = 5, most: int = 10) -> DataFrame:
    """click+view counts joined to the catalog, top min(limit, most) (ties by id); the shop shows at most 10."""
    n = min(int(limit), most)
    counts = (events.where(F.col("event_type").isin("click", "view"))
              .groupBy("item_id").agg(F.count(F.lit(1)).alias("interactions")))
    j = counts.join(products.select("item_id", "product_name", "category", "price"), "item_id")
    return j.orderBy(F.desc("interactions"), F.asc("item_id")).limit(n)


# D19 ------------------------------------------------------------------------
def catalog_facets(products: DataFrame, facet_cols: Sequence[str] = ("category",)) -> DataFrame:
    """(facet, value, n): counts of each facet column in one pass, a row per column and value, no combinations."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facet_cols])
    return products.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


# D24 ------------------------------------------------------------------------
def date_bounds(events: DataFrame, ts_col: str = "ts") -> DataFrame:
    d = F.to_date(F.col(ts_col))
    return events.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                      F.count_distinct("user_id").alias("n_users"))


# B12 ------------------------------------------------------------------------
def enrich_events(raw: DataFrame, time_col: str = "event_time") -> DataFrame:
    """Parse time (UTC), drop unparsable rows, user_id as text, add event_date."""
    ts = F.try_to_timestamp(F.col(time_col).cast("string"))
    return (raw.withColumn("ts", ts).where(F.col("ts").isNotNull())
            .withColumn("user_id", F.col("user_id").cast("string"))
            .withColumn("event_date", F.to_date("ts")))


# B18 ------------------------------------------------------------------------
def valid_dwell(events: DataFrame) -> DataFrame:
    """time_spent rows kept only when seconds > 0 (non-numeric / missing -> 0)."""
    secs = F.coalesce(F.col("time_spent_seconds").try_cast("double"), F.lit(0.0))
    return events.where((F.col("event_type") != "time_spent") | (secs > 0))


# B15 / B17 ------------------------------------------------------------------
def user_history(events: DataFrame, users: DataFrame) -> DataFrame:
    """All events of the users listed in ``users`` (semi join, any number of users)."""
    return events.join(users.select("user_id").distinct(), "user_id", "left_semi")


def fetch_cart(cart: DataFrame, requests: DataFrame) -> DataFrame:
    """Cart rows for (user_id, session_id) requests; NULL session matches NULL."""
    c = cart.alias("c")
    r = requests.select("user_id", "session_id").alias("r")
    cond = (F.col("c.user_id") == F.col("r.user_id")) & \
        F.col("c.session_id").eqNullSafe(F.col("r.session_id"))
    return c.join(r, cond, "left_semi")
