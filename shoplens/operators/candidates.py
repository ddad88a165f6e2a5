"""Candidate retrieval for all users at once.

Plan: recent window (global max - N days) -> per-user query vector
(weighted Σ, normalised) -> exact search over the items in stock for N rows
and as many more as the user has purchases among them -> drop those -> first N.
Users with no in-window event or no vector fall back to the popularity list
(score 0, is_cold_start).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.weights import RECENCY_DAYS
from shoplens.operators.analytics import global_row_number, in_stock_filter, recent_events
from shoplens.operators.vectors import embedded_items, query_vectors, vector_topn
from shoplens.session import cut_lineage


# F1 -------------------------------------------------------------------------
def popular_items(products: DataFrame, n: int | None = None) -> DataFrame:
    """Catalog by popularity_score desc (ties: item_id), with its 1-based rank."""
    order = [F.desc("popularity_score"), F.asc("item_id")]
    p = products.select("item_id", "popularity_score", "in_stock")
    if n is None:
        return global_row_number(p, order, "pop_rank")
    # TakeOrdered keeps only n rows per partition before the global order, so the
    # window below ranks at most n rows
    return p.orderBy(*order).limit(n).withColumn("pop_rank", F.row_number().over(Window.orderBy(*order)))


# C6 -------------------------------------------------------------------------
def exclude_pairs(cands: DataFrame, excluded: DataFrame) -> DataFrame:
    """Anti-join on (user_id, item_id)."""
    return cands.join(excluded.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def purchased_pairs(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select("user_id", "item_id").distinct()


# F2 -------------------------------------------------------------------------
def topn_overfetch(scored: DataFrame, n: int, keep, overfetch: int | None = 3,
                   key: str = "user_id", score: str = "score") -> DataFrame:
    """Take the best ``overfetch·n`` (already ranked as ``rank``), apply ``keep``
    (DataFrame -> DataFrame filter), then the first n. ``overfetch=None`` filters first."""
    pre = scored if overfetch is None else scored.where(F.col("rank") <= overfetch * n)
    kept = keep(pre)
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc("item_id"))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# J3 -------------------------------------------------------------------------
NEAR_RANKS = 1024  # ranks beyond n that are sent to all tasks; rarer ones are joined


def fill_from_ranking(keys: DataFrame, ranking: DataFrame, n: int, excluded: DataFrame | None, key: str) -> DataFrame:
    """(key, item_id, rank): each key's first n items of a global ranking (item_id, pop_rank) but its excluded ones.

    The i-th of a key's excluded ranks matters if it is at most n + i - 1; with
    m such exclusions the key's list ends at rank n + m. So each key reads n + m
    ranks, whatever other keys exclude.
    """
    ends = keys.select(key, F.lit(n).cast("long").alias("end"))
    if excluded is not None:
        own = excluded.select(key, "item_id").distinct().join(keys.select(key), key, "left_semi")
        placed = own.join(ranking, "item_id").select(key, "pop_rank")
        before = F.row_number().over(Window.partitionBy(key).orderBy("pop_rank")) - 1
        more = placed.withColumn("_i", before).where(F.col("pop_rank") - F.col("_i") <= n) \
            .groupBy(key).agg(F.count("*").alias("_m"))
        ends = ends.join(more, key, "left").select(key, (F.col("end") + F.coalesce("_m", F.lit(0))).alias("end"))
    near = n + NEAR_RANKS
    # the first ranks are every key's: a table of at most n + NEAR_RANKS rows; the others are few keys'
    first = ends.select(key, F.explode(F.sequence(F.lit(1), F.least("end", F.lit(near)))).alias("pop_rank")) \
        .join(F.broadcast(ranking.where(F.col("pop_rank") <= near)), "pop_rank")
    rest = ends.where(F.col("end") > near).select(key, F.explode(F.sequence(F.lit(near + 1), F.col("end"))).alias("pop_rank")) \
        .join(ranking, "pop_rank")
    out = first.unionByName(rest)
    if excluded is not None:
        out = out.join(own, [key, "item_id"], "left_anti")
    w = Window.partitionBy(key).orderBy("pop_rank")
    return out.withColumn("rank", F.row_number().over(w)).select(key, "item_id", "rank")


def cold_start(users: DataFrame, products: DataFrame, n: int, excluded: DataFrame | None,
               filter_out_of_stock: bool = True) -> DataFrame:
    """Popular items for each listed user: stock filter, minus the user's excluded
    items, first n; similarity 0 and is_cold_start true."""
    pool = products.where(F.col("in_stock")) if filter_out_of_stock else products
    out = fill_from_ranking(users, popular_items(pool).select("item_id", "pop_rank"), n, excluded, "user_id")
    return out.select("user_id", "item_id", F.lit(0.0).alias("similarity_score"), F.lit(True).alias("is_cold_start"), "rank")


# J1 -------------------------------------------------------------------------
def candidates(events: DataFrame, products: DataFrame, embeddings: DataFrame, top_n: int = 100,
               recency_days: int = RECENCY_DAYS, filter_out_of_stock: bool = True,
               exclude_purchased: bool = True, overfetch: int | None = None,
               users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, similarity_score, is_cold_start, rank) for every user.

    ``users`` defaults to everyone in ``events``; listed users without events
    are cold-start. ``products`` needs popularity_score and in_stock. Filters
    come before the cut to ``top_n``, so lists are full where the catalog
    allows; with ``overfetch`` the best ``overfetch * top_n`` are taken first
    and filtered afterwards.
    """
    recent = recent_events(events, recency_days)
    items = embedded_items(embeddings, products)
    all_users = (users if users is not None else events).select("user_id").distinct()
    # read several times (search sizing, search, cold-start anti join): materialise once
    qv = cut_lineage(query_vectors(recent, items).join(all_users, "user_id", "left_semi"))
    excluded = purchased_pairs(recent) if exclude_purchased else None

    if overfetch is None:
        if filter_out_of_stock:
            items = in_stock_filter(items, products)
        extra = None
        if excluded is not None:
            extra = excluded.join(items.select("item_id"), "item_id", "left_semi").groupBy("user_id").count()
        warm = vector_topn(qv, items, top_n, extra=extra).withColumnRenamed("score", "similarity_score")
        if excluded is not None:
            warm = exclude_pairs(warm, excluded)
        w = Window.partitionBy("user_id").orderBy(F.desc("similarity_score"), F.asc("item_id"))
        warm = warm.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    else:
        def keep(df):
            out = df if excluded is None else exclude_pairs(df, excluded)
            return in_stock_filter(out, products) if filter_out_of_stock else out

        fetched = vector_topn(qv, items, top_n * overfetch).withColumnRenamed("score", "similarity_score")
        warm = topn_overfetch(fetched, top_n, keep, overfetch=overfetch, score="similarity_score")
    warm = warm.select("user_id", "item_id", "similarity_score", F.lit(False).alias("is_cold_start"), "rank")
    cold_users = all_users.join(qv.select("user_id"), "user_id", "left_anti")
    if cold_users.isEmpty():
        return warm
    cold = cold_start(cold_users, products, top_n, excluded, filter_out_of_stock)
    return warm.unionByName(cold)
