"""Catalog and event sources.

Readers take an explicit schema where the layout is known; column checks and
defaults are plain projections so Catalyst still prunes and pushes filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators.analytics import global_row_number

PRODUCT_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("image_url", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("in_stock", T.BooleanType()),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("time_spent_seconds", T.DoubleType()),
])


# A1 -------------------------------------------------------------------------
def require_columns(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Fail fast (at plan time, no job) when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing optional column as a typed literal default."""
    out = df
    for col, value in defaults.items():
        if col not in out.columns:
            out = out.withColumn(col, F.lit(value))
    return out


def scan_catalog(spark: SparkSession, products_path: str, events_path: str, fmt: str = "parquet",
                 options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Read products + events, check required columns, default the optional ones."""
    reader = spark.read.options(**(options or {}))
    products = reader.format(fmt).load(products_path)
    events = reader.format(fmt).load(events_path)
    require_columns(products, ["item_id", "product_name", "category", "brand", "price"], "products")
    require_columns(events, ["user_id", "item_id", "event_type", "timestamp"], "events")
    products = with_defaults(products, {"image_url": "", "description": "", "in_stock": True})
    return products, events


# A2 -------------------------------------------------------------------------
def scan_json_catalog(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Product list stored as one JSON array per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


# A3 -------------------------------------------------------------------------
def scan_events(spark: SparkSession, path: str, fmt: str = "parquet", newest_first: bool = False) -> DataFrame:
    """Event log scan; the newest-first order is applied only when asked (exports)."""
    df = spark.read.format(fmt).load(path)
    return df.orderBy(F.desc("timestamp")) if newest_first else df


def scan_events_jdbc(spark: SparkSession, url: str, table: str, properties: dict,
                     partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                     num_partitions: int = 8) -> DataFrame:
    """Event log from a JDBC table, split into parallel range reads when bounds are given."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


# A4 -------------------------------------------------------------------------
def embeddings_from_mapping(df: DataFrame, key: str = "item_id", vec: str = "embedding") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("item_id"),
                     F.transform(vec, lambda x: x.cast("double")).alias("embedding"))


def embeddings_from_parallel(chunks: DataFrame, ids: str = "product_ids", vecs: str = "vectors") -> DataFrame:
    """Chunks of parallel (ids, vectors) arrays; each chunk is cut to the shorter array."""
    n = F.least(F.size(ids), F.size(vecs))
    z = chunks.select(F.arrays_zip(F.slice(ids, 1, n).alias("i"), F.slice(vecs, 1, n).alias("v")).alias("z"))
    return z.select(F.inline("z")).select(F.col("i").cast("string").alias("item_id"),
                                          F.transform("v", lambda x: x.cast("double")).alias("embedding"))


def embeddings_from_matrix(matrix: DataFrame, catalog: DataFrame, order: Sequence[Column],
                           pos_col: str = "pos", vec: str = "embedding") -> DataFrame:
    """Bare matrix rows (pos 0..n-1) aligned with the catalog's position in ``order``."""
    numbered = global_row_number(catalog.select("item_id"), order, "_rn").select(
        "item_id", (F.col("_rn") - 1).alias(pos_col))
    return matrix.join(numbered, pos_col).select(
        "item_id", F.transform(vec, lambda x: x.cast("double")).alias("embedding"))


# A5 -------------------------------------------------------------------------
SIMILARITY_COLUMNS = ["query_id", "similar_id", "similarity_score"]


def pick_similarity_table(candidates: Sequence[DataFrame]) -> DataFrame | None:
    """First candidate carrying query_id / similar_id / similarity_score."""
    for df in candidates:
        if all(c in df.columns for c in SIMILARITY_COLUMNS):
            return df
    return None


def scan_similarity_table(spark: SparkSession, folders: Sequence[str], preferred: Sequence[str] = ()) -> DataFrame | None:
    """First CSV or Parquet table of the folders with rows and the columns of a similarity table.

    Folders in order; in a folder the ``preferred`` file names come first, then
    all others by name. Folders that aren't there are passed over. Paths are
    listed and read by Spark, so they may lie in any store it knows.
    """
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").load(folder).select("path").collect()  # a listing: no file is read
        except AnalysisException:
            continue
        names = sorted(r["path"].rsplit("/", 1)[-1] for r in files)
        names = [n for n in preferred if n in names] + [n for n in names if n not in preferred]
        for name in names:
            at = f"{folder.rstrip('/')}/{name}"
            if name.lower().endswith(".csv"):
                df = spark.read.option("header", True).csv(at)
            elif name.lower().endswith(".parquet"):
                df = spark.read.parquet(at)
            else:
                continue
            if pick_similarity_table([df]) is not None and not df.isEmpty():
                return df.withColumn("similarity_score", F.col("similarity_score").cast("double"))
    return None


# A6 -------------------------------------------------------------------------
def upsert_products(current: DataFrame, incoming: DataFrame, price: float = 1000.0) -> DataFrame:
    """Import rows by id, last row wins; name <- display name -> article type ->
    'Product <id>'; category <- master category -> 'fashion'; fixed price."""
    inc = incoming.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("productDisplayName"), F.col("articleType"),
                   F.concat(F.lit("Product "), F.col("id").cast("string"))).alias("name"),
        F.coalesce(F.col("masterCategory"), F.lit("fashion")).alias("category"),
        F.lit(price).alias("price"), F.lit(1).alias("_src"), F.col("_seq"))
    cur = current.select(F.col("id").cast("long").alias("id"), "name", "category",
                         F.col("price").cast("double").alias("price"), F.lit(0).alias("_src"),
                         F.lit(0).cast("long").alias("_seq"))
    w = Window.partitionBy("id").orderBy(F.desc("_src"), F.desc("_seq"))
    return (cur.unionByName(inc).withColumn("_k", F.row_number().over(w)).where("_k = 1")
            .drop("_k", "_src", "_seq"))


# A13 ------------------------------------------------------------------------
ASSET_COLUMNS = ["price", "master_category", "sub_category", "article_type", "gender"]


def asset_catalog(listing: DataFrame, products: DataFrame, asset_base: str) -> DataFrame:
    """Image keys (.jpg/.png/.jpeg) -> product rows; numeric basenames join the
    catalog, other names take their 1-based position in the listing as id.
    Columns of ASSET_COLUMNS that the catalog lacks are null."""
    numbered = global_row_number(listing.select("key"), [F.col("key")], "ordinal")
    imgs = numbered.where(F.col("key").rlike(r"\.(jpg|png|jpeg)$"))
    base = F.regexp_replace(F.element_at(F.split("key", "/"), -1), r"\.[^.]*$", "")
    num = base.try_cast("long")
    imgs = imgs.select("key", "ordinal", base.alias("base_name"), num.alias("_num"))
    p = products.select(F.col("item_id").try_cast("long").alias("_num"), F.col("product_name").alias("_pname"),
                        *[F.col(c) if c in products.columns else F.lit(None).cast("string").alias(c) for c in ASSET_COLUMNS])
    j = imgs.join(p, "_num", "left")
    return j.select(
        F.coalesce(F.col("_num"), F.col("ordinal")).alias("id"),
        F.when(F.col("_num").isNotNull(), F.coalesce(F.nullif(F.col("_pname"), F.lit("")), F.col("base_name")))
        .otherwise(F.col("base_name")).alias("name"),
        F.concat(F.lit(asset_base.rstrip("/") + "/"), F.col("key")).alias("image_url"),
        *[F.when(F.col("_num").isNotNull(), F.col(c)).alias(c) for c in ASSET_COLUMNS])


# A14 ------------------------------------------------------------------------
def text_expr(df: DataFrame, candidates: Sequence[str], default: str | None = None,
              ignore_unknown: bool = True) -> Column:
    """First usable candidate column present in ``df`` ('' and 'Unknown' count as missing)."""
    parts = []
    for c in candidates:
        if c in df.columns:
            v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
            if ignore_unknown:
                v = F.nullif(v, F.lit("Unknown"))
            parts.append(v)
    parts.append(F.lit(default))
    return F.coalesce(*parts)


def conform_columns(df: DataFrame, spec: dict[str, tuple[Sequence[str], str | None]]) -> DataFrame:
    """Build each logical column from its candidate physical columns."""
    return df.select(*[text_expr(df, cands, default).alias(name) for name, (cands, default) in spec.items()])


# A16 ------------------------------------------------------------------------
def upsert_users(logins: DataFrame) -> DataFrame:
    """Per trimmed, lower-cased e-mail: latest name, first and last login."""
    e = logins.select(F.lower(F.trim("email")).alias("email"), F.trim("name").alias("name"), "ts")
    # latest login wins; same-instant logins resolve to the greatest name (deterministic)
    return e.groupBy("email").agg(F.max_by("name", F.struct("ts", "name")).alias("name"),
                                  F.min("ts").alias("created_at"),
                                  F.max("ts").alias("last_login_at"))
