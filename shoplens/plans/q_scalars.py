"""Registered scalar-function queries (H1-H9, H12-H17) over catalog/customer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions import scalars as S
from shoplens.plans.base import r6, register
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

ASSET_BASE = "https://assets.shop.test/img"
OLD_HOST = r"old-assets(?:-[a-z0-9]+)?\.example\.org"

# search requests derived from the catalog: one per part
REQ_SPARK = lambda p: F.concat(
    F.lit("Show me  "), F.col("p_name"), F.lit(" under Rs. "),
    (F.col("p_retailprice").cast("int") + F.col("p_size") * 3).cast("string"), F.lit(" please"))
REQ_SQL = ("'Show me  ' || p_name || ' under Rs. ' || CAST(CAST(trunc(p_retailprice) AS INTEGER) + p_size * 3 "
           "AS VARCHAR) || ' please'")


@register("brand_from_name", with_views(["products"], f"""
SELECT item_id, {S.BRAND_SQL.format(x="product_name")} AS brand_guess FROM products"""))
def q_brand(spark, d):
    return X.products(spark, d).select("item_id", S.brand_from_name("product_name").alias("brand_guess"))


@register("type_from_name", with_views(["products"], f"""
SELECT item_id, {S.type_from_name_sql("product_name")} AS product_type FROM products"""))
def q_type(spark, d):
    return X.products(spark, d).select("item_id", S.type_from_name("product_name").alias("product_type"))


def _type_cat_sql():
    raw = "CASE WHEN price_flag THEN category END"
    usable = f"(CASE WHEN lower(trim({raw})) IN ('unknown','none','nan','') THEN NULL ELSE lower(trim({raw})) END)"
    ptype = f"coalesce({usable}, {S.type_from_name_sql('product_name')})"
    groups = " ".join(
        f"WHEN ptype IN ({', '.join(repr(t) for t in types)}) THEN '{g}'" for g, types in S.CATEGORY_GROUPS)
    return with_views(["products"], f"""
SELECT item_id, ptype AS product_type,
       coalesce(ucat, CASE {groups} WHEN ptype <> 'unknown' THEN 'apparel' ELSE 'unknown' END)
         AS catalog_category
FROM (SELECT item_id, {ptype} AS ptype, {usable} AS ucat FROM
      (SELECT *, (CAST(item_id AS BIGINT) % 2 = 0) AS price_flag FROM products))""")


@register("catalog_category", _type_cat_sql())
def q_catalog_category(spark, d):
    p = X.products(spark, d).withColumn(
        "raw_cat", F.when(F.col("item_id").cast("long") % 2 == 0, F.col("category")))
    p = p.withColumn("product_type", S.product_type("raw_cat", name_col="product_name"))
    return p.select("item_id", "product_type",
                    S.catalog_category("raw_cat", "product_type").alias("catalog_category"))


def _label_case(value: str, table, other: str, contains: bool = False) -> str:
    def hit(texts):
        if contains:
            return " OR ".join(f"contains({value}, '{t}')" for t in texts)
        return f"{value} IN ({', '.join(repr(t) for t in texts)})"
    return f"(CASE {' '.join(f'WHEN {hit(ts)} THEN {label!r}' for label, ts in table)} ELSE {other} END)"


def _app_sql() -> str:
    """Every part with its name doubled into the app's columns: types by name, by sub category and by category."""
    title = ("list_aggregate(list_transform(string_split(lower({x}), ''), lambda c, i: CASE WHEN i = 1 OR NOT "
             "regexp_matches(string_split(lower({x}), '')[i - 1], '\\p{{L}}') THEN upper(c) ELSE c END), 'string_agg', '')")
    by_name = _label_case("lower(name)", S.APP_TYPE_KEYWORDS, "NULL", contains=True)
    narrow = f"CASE WHEN lower(category) NOT IN ({', '.join(map(repr, S.APP_BROAD_CATEGORIES))}) THEN category END"
    category = _label_case("lower(category)", S.APP_CATEGORY_LABELS, "category")
    group = _label_case("t", S.APP_CATEGORY_GROUPS, "CASE WHEN t <> 'Unknown' THEN 'Apparel' ELSE 'Unknown' END")
    return f"""
SELECT item_id, t AS product_type, coalesce(CASE WHEN category IS NULL THEN NULL ELSE {category} END, {group}) AS catalog_category
FROM (SELECT item_id, category, CASE WHEN v IS NULL THEN 'Unknown' ELSE {_label_case('lower(v)', S.APP_TYPE_LABELS, title.format(x='v'))} END AS t
      FROM (SELECT item_id, category, coalesce(sub_category, {narrow}, {by_name}) AS v FROM ({APP_SQL})))"""


# parts in the app's columns: by size a broad category, none, or the part's own type; some with a sub category
APP_SQL = """
SELECT p_partkey AS item_id, p_name || ' ' || CASE p_size % 4 WHEN 0 THEN 'Ring' WHEN 1 THEN 'track pant' WHEN 2 THEN 'T-Shirt bra' ELSE 'x' END AS name,
       CASE p_size % 3 WHEN 0 THEN 'Footwear' WHEN 1 THEN p_type END AS category,
       CASE WHEN p_size % 5 = 0 THEN lower(p_brand) || '-top wear' WHEN p_size % 5 = 1 THEN 'Sports Shoes' END AS sub_category FROM part"""


@register("app_catalog_labels", _app_sql())
def q_app_catalog_labels(spark, d):
    """H2 / H3: the app's 36 name rules, canonical type labels and category labels."""
    size = F.col("p_size")
    p = X.table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.when(size % 4 == 0, F.lit("Ring")).when(size % 4 == 1, F.lit("track pant"))
                 .when(size % 4 == 2, F.lit("T-Shirt bra")).otherwise(F.lit("x"))).alias("name"),
        F.when(size % 3 == 0, F.lit("Footwear")).when(size % 3 == 1, F.col("p_type")).alias("category"),
        F.when(size % 5 == 0, F.concat(F.lower("p_brand"), F.lit("-top wear"))).when(size % 5 == 1, F.lit("Sports Shoes")).alias("sub_category"))
    p = p.withColumn("product_type", S.app_product_type(F.lit(None), "sub_category", "category", "name"))
    return p.select("item_id", "product_type", S.app_catalog_category(
        F.lit(None), "category", F.lit(None), "product_type").alias("catalog_category"))


@register("normalize_search_text", f"""
SELECT p_partkey AS request_id, {S.normalize_search_text_sql(REQ_SQL)} AS normalized,
       {S.parse_budget_sql(REQ_SQL)} AS budget FROM part""")
def q_normalize(spark, d):
    p = X.table(spark, d, "part").withColumn("req", REQ_SPARK(None))
    return p.select(F.col("p_partkey").alias("request_id"),
                    S.normalize_search_text("req").alias("normalized"),
                    S.parse_budget("req").alias("budget"))


IMG_RAW_SQL = ("CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN '//cdn.shop.test/a/' || p_partkey || '.jpg' "
               "WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 4 THEN 'imgs/sub/' || p_partkey || '.png' "
               "ELSE 'http://old-assets.example.org/k/' || p_partkey || '.jpg' END")


def _img_raw():
    s, k = F.col("p_size") % 6, F.col("p_partkey").cast("string")
    return (F.when(s == 0, F.lit(None)).when(s == 1, F.lit("nan"))
            .when(s == 2, F.concat(F.lit("//cdn.shop.test/a/"), k, F.lit(".jpg")))
            .when(s == 3, k).when(s == 4, F.concat(F.lit("imgs/sub/"), k, F.lit(".png")))
            .otherwise(F.concat(F.lit("http://old-assets.example.org/k/"), k, F.lit(".jpg"))))


@register("normalize_image_url", f"""
SELECT p_partkey AS item_id, CASE
  WHEN raw LIKE 'http%' AND regexp_extract(raw, '{OLD_HOST}/(.*)$', 1) <> ''
    THEN '{ASSET_BASE}/' || regexp_extract(raw, '{OLD_HOST}/(.*)$', 1)
  WHEN raw LIKE 'http://%' OR raw LIKE 'https://%' OR raw LIKE 'data:image/%' THEN raw
  WHEN raw LIKE '//%' THEN 'https:' || raw
  WHEN regexp_matches(raw, '^[0-9]+$') THEN '{ASSET_BASE}/' || raw || '.jpg'
  WHEN raw <> '' AND contains(split_part(raw, '/', -1), '.') THEN '{ASSET_BASE}/' || split_part(raw, '/', -1)
  ELSE '{ASSET_BASE}/' || p_partkey || '.jpg' END AS image_url
FROM (SELECT p_partkey, CASE WHEN lower(trim(coalesce(r, ''))) IN ('', 'none', 'nan', 'null') THEN ''
             ELSE trim(r) END AS raw FROM (SELECT p_partkey, {IMG_RAW_SQL} AS r FROM part))""")
def q_image_url(spark, d):
    p = X.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("item_id"),
                    S.normalize_image_url(_img_raw(), F.col("p_partkey"), ASSET_BASE, OLD_HOST)
                    .alias("image_url"))


@register("customer_text_fields", f"""
SELECT c_custkey, concat_ws('|', CAST(c_custkey AS VARCHAR), coalesce(CASE WHEN c_nationkey % 2 = 0 THEN
         CAST(c_nationkey AS VARCHAR) END, 'None'), c_mktsegment, CAST(c_custkey % 97 AS VARCHAR)) AS tracking_key,
       regexp_matches(lower(trim(replace(c_name, '#', '.') || '@shop.test')), '{S.EMAIL_PATTERN}') AS email_ok,
       regexp_matches(lower(trim(c_name || '@shop.test')), '{S.EMAIL_PATTERN}') AS raw_email_ok,
       CASE WHEN c_acctbal IS NULL OR c_acctbal = 0 THEN 'N/A'
            ELSE 'INR ' || CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) END AS price_text,
       TRY_CAST(c_mktsegment AS DOUBLE) AS seg_num
FROM customer""")
def q_customer_text(spark, d):
    c = X.table(spark, d, "customer")
    sess = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey"))
    return c.select(
        "c_custkey",
        S.tracking_key(F.col("c_custkey"), sess, F.col("c_mktsegment"), F.col("c_custkey") % 97)
        .alias("tracking_key"),
        S.valid_email(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@shop.test"))).alias("email_ok"),
        S.valid_email(F.concat(F.col("c_name"), F.lit("@shop.test"))).alias("raw_email_ok"),
        S.price_text("c_acctbal").alias("price_text"),
        S.safe_float("c_mktsegment").alias("seg_num"))


@register("time_decay", with_views(["ev"], """
SELECT event_id,
       round(pow(0.995, abs(epoch_us((SELECT max(ts) FROM ev)) - epoch_us(ts)) / 3600000000.0), 6) AS decay,
       round(greatest((epoch_us((SELECT max(ts) FROM ev)) - epoch_us(ts)) / 3600000000.0, 0.0), 6) AS hours_since,
       round(ln(1 + greatest((epoch_us((SELECT max(ts) FROM ev)) - epoch_us(ts)) / 3600000000.0, 0.0)), 6)
         AS log_hours
FROM ev"""))
def q_time_decay(spark, d):
    ev = X.events(spark, d)
    now = ev.select(F.max("ts")).scalar()
    hs = S.hours_since(F.col("ts"), now)
    return ev.select("event_id", r6(S.time_decay(F.col("ts"), now)).alias("decay"),
                     r6(hs).alias("hours_since"), r6(F.log1p(hs)).alias("log_hours"))


@register("cheapness", with_views(["products"], """
SELECT item_id, round(CASE WHEN hi - lo > 0 THEN greatest(0.0, least(1.0, (hi - price) / (hi - lo))) * 2.0
                           WHEN price > 0 THEN 1.0 ELSE 0.0 END, 6) AS cheapness
FROM (SELECT item_id, price, min(price) OVER (PARTITION BY category) AS lo,
             max(price) OVER (PARTITION BY category) AS hi FROM products)"""))
def q_cheapness(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("category")
    p = X.products(spark, d).withColumn("lo", F.min("price").over(w)).withColumn("hi", F.max("price").over(w))
    return p.select("item_id", r6(S.cheapness("price", "lo", "hi")).alias("cheapness"))
