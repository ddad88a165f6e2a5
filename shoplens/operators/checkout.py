"""Checkout recommendations for every open cart.

Input carts are (cart_id, item_id, quantity[, added_at]); every operator works
on all carts in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions import scalars as S
from shoplens.functions import vectors as V
from shoplens.functions.weights import (BLEND_MODEL, BLEND_SIMILARITY, CHECKOUT_RECENCY_DAYS, INTERACTION_DEFAULT,
                                        INTERACTION_WEIGHTS, RULE_BRAND, RULE_CATEGORY, RULE_GENDER, RULE_OTHER_TYPE,
                                        RULE_SAME_TYPE, RULE_SHARED_TYPE, RULE_UNKNOWN_TYPE, weight_of)
from shoplens.operators.analytics import global_row_number, recent_events
from shoplens.operators.candidates import fill_from_ranking, popular_items
from shoplens.operators.cells import dense_topk
from shoplens.operators.features import build_features
from shoplens.operators.ranking import diversity_rerank, linear_score, minmax_norm, trending_boost
from shoplens.operators.vectors import weighted_vector_sum
from shoplens.session import cut_lineage

CART_WEIGHT = 2.0  # of a cart line in a query vector


def _cart_ids(carts: DataFrame) -> DataFrame:
    return carts.select("cart_id", "item_id").distinct()


# J13 ------------------------------------------------------------------------
def item_attributes(products: DataFrame) -> DataFrame:
    """product_type, catalog category, gender and name-derived brand of every item."""
    cols = set(products.columns)
    type_src = [c for c in ("product_type", "article_type", "sub_category", "category") if c in cols]
    ptype = S.product_type(*type_src, name_col="product_name")
    p = products.withColumn("_type", ptype)
    gender = F.lower(F.trim(F.col("gender").cast("string"))) if "gender" in cols else F.lit(None)
    return p.select(
        "item_id", F.col("price").cast("double").alias("price"), "_type",
        S.catalog_category(F.col("category") if "category" in cols else F.lit(None), F.col("_type")).alias("_cat"),
        F.when(gender != "", gender).alias("_gender"),
        S.brand_from_name("product_name").alias("_brand"))


def _price_ranges(priced: DataFrame, carts: DataFrame) -> DataFrame:
    """(cart_id, _lo, _hi): lowest and highest positive price outside each cart.

    Both ends of one ranking by price; a cart looks as far into it as its own items stand there.
    """
    up = global_row_number(priced, [F.col("price"), F.col("item_id")], "pop_rank")
    down = up.withColumn("pop_rank", up.select(F.count("*")).scalar() + 1 - F.col("pop_rank"))
    keys = carts.select("cart_id").distinct()

    def end(ranking: DataFrame, name: str) -> DataFrame:
        first = fill_from_ranking(keys, ranking.select("item_id", "pop_rank"), 1, carts, "cart_id")
        return first.join(ranking.select("item_id", "price"), "item_id").select("cart_id", F.col("price").alias(name))

    return end(up, "_lo").join(end(down, "_hi"), "cart_id")


def metadata_candidates(products: DataFrame, carts: DataFrame, top_n: int = 10) -> DataFrame:
    """Heuristic candidates per cart: type match +8 (unknown -3 / other -2 when the
    cart has known types, else +4 for a shared type), category +2, gender +0.8,
    name brand +0.6, plus a cheapness bonus (H14) over non-cart prices.

    Exact without scoring every catalog item for every cart: inside one
    attribute combination (type, category, gender, brand) all items share the
    rule score and cheaper ones come first, so of each combination only the
    ``top_n`` cheapest outside the cart can make its list. Those lists are
    reached through equi-joins on the cart's attributes, those of its types only
    as far as the cart's order of their first items asks for; items sharing nothing
    with a cart come from the ranking of all items, as far as the cart's own
    items make it necessary. No list is sized by another cart.
    """
    # catalog-sized, read by several joins: materialise once
    attrs = cut_lineage(item_attributes(products))
    own = cut_lineage(_cart_ids(carts))
    cart_items = cut_lineage(own.join(attrs, "item_id"))  # cart items known to the catalog
    pos = (F.col("price") > 0) & F.col("price").isNotNull()
    cheap_order = [F.desc(pos.cast("int")), F.asc("price"), F.asc("item_id")]
    combo = ["_type", "_cat", "_gender", "_brand"]

    sets = cut_lineage(cart_items.groupBy("cart_id").agg(
        F.collect_set(F.when(F.col("_type") != "unknown", F.col("_type"))).alias("_known_types"),
        F.collect_set("_type").alias("_types"),
        F.collect_set(F.when(F.col("_cat") != "unknown", F.col("_cat"))).alias("_cats"),
        F.collect_set("_gender").alias("_genders"),
        F.collect_set(F.when(F.col("_brand") != "unknown", F.col("_brand"))).alias("_brands")))
    known_carts = own.join(sets.select("cart_id"), "cart_id", "left_semi")
    ranges = cut_lineage(_price_ranges(attrs.where(pos).select("item_id", "price"), known_carts))

    has_known = F.size("_known_types") > 0
    type_term = (F.when(has_known & F.array_contains("_known_types", F.col("_type")), RULE_SAME_TYPE)
                 .when(has_known & (F.col("_type") == "unknown"), RULE_UNKNOWN_TYPE)
                 .when(has_known, RULE_OTHER_TYPE)
                 .when((F.col("_type") != "unknown") & F.array_contains("_types", F.col("_type")), RULE_SHARED_TYPE)
                 .otherwise(0.0))
    lo, hi = F.coalesce(F.col("_lo"), F.lit(0.0)), F.coalesce(F.col("_hi"), F.lit(0.0))
    price = F.coalesce(F.col("price"), F.lit(0.0))
    cheap = (F.when((price > 0) & (hi > lo), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - price) / (hi - lo))) * 2.0)
             .when((price > 0) & (hi > 0), 1.0).otherwise(0.0))
    score = (type_term
             + F.when((F.col("_cat") != "unknown") & F.array_contains("_cats", F.col("_cat")), RULE_CATEGORY).otherwise(0.0)
             + F.when(F.col("_gender").isNotNull() & F.array_contains("_genders", F.col("_gender")), RULE_GENDER)
             .otherwise(0.0)
             + F.when((F.col("_brand") != "unknown") & F.array_contains("_brands", F.col("_brand")), RULE_BRAND)
             .otherwise(0.0)
             + cheap)

    def best_of_combinations(order: list) -> DataFrame:
        """The top_n first of each combination, and as many more as the cart with most of its items there has."""
        overlap = (cart_items.groupBy("cart_id", *combo).agg(F.count(F.lit(1)).alias("_o"))
                   .groupBy(*combo).agg(F.max("_o").alias("_o"))
                   .select(*[F.col(c).alias(f"_ov{c}") for c in combo], "_o"))
        cond = None
        for c in combo:
            e = F.col(c).eqNullSafe(F.col(f"_ov{c}"))
            cond = e if cond is None else cond & e
        w = Window.partitionBy(*combo).orderBy(*order)
        return attrs.join(overlap, cond, "left").withColumn("_r", F.row_number().over(w)) \
            .where(F.col("_r") <= F.lit(top_n) + F.coalesce(F.col("_o"), F.lit(0))) \
            .drop(*[f"_ov{c}" for c in combo], "_o").withColumn("_combo", F.to_json(F.struct(*combo)))

    def typed_of(wanted: DataFrame, trimmed: DataFrame) -> DataFrame:
        """(cart_id, item_id) with a type of the cart, outside the cart, among which the cart's top_n of those are.

        An item at place p of the combination whose first item is the cart's r-th has r + p - 2 rows before
        it, of which as many as the cart has of the listed items don't count.
        """
        heads = cut_lineage(trimmed.where("_r = 1").withColumn("_c", F.monotonically_increasing_id()))
        places = trimmed.join(heads.select("_combo", "_c"), "_combo").select("_c", "item_id", F.col("_r").alias("_p"))
        inside = own.join(trimmed.select("item_id"), "item_id").groupBy("cart_id").agg(F.count("*").alias("_in"))
        keys = wanted.withColumn("_type", F.explode("_known_types")).join(ranges, "cart_id", "left")
        by_first = Window.partitionBy("cart_id").orderBy(F.desc("_s"), F.asc("item_id"))
        ranked = keys.join(heads.drop("_r", "_combo"), "_type").select("cart_id", "_c", "item_id", score.alias("_s")) \
            .withColumn("_r", F.row_number().over(by_first)).join(inside, "cart_id", "left") \
            .withColumn("_up", F.lit(top_n) + F.coalesce("_in", F.lit(0))).where(F.col("_r") <= F.col("_up")) \
            .select("cart_id", "_c", (F.col("_up") + 1 - F.col("_r")).alias("_up"))
        return cut_lineage(ranked.join(places, "_c").where(F.col("_p") <= F.col("_up")).select("cart_id", "item_id")
                           .join(own, ["cart_id", "item_id"], "left_anti"))

    def pool_of(wanted: DataFrame, order: list) -> DataFrame:
        """(cart_id, item_id) outside the cart among which its top_n are, for carts that rank equals by ``order``."""
        trimmed = cut_lineage(best_of_combinations(order))

        def via(src, attr_col, set_col):
            keys = src.select("cart_id", F.explode(set_col).alias(attr_col))
            return keys.join(trimmed.select("item_id", attr_col), attr_col).select("cart_id", "item_id")

        # Type dominance: a type-matched item scores >= 8, any other <= 3.4. A cart
        # with at least top_n type-matched candidates needs nothing else.
        typed = typed_of(wanted, trimmed)
        enough = typed.groupBy("cart_id").count().where(F.col("count") >= top_n).select("cart_id")
        rest = cut_lineage(wanted.join(enough, "cart_id", "left_anti"))
        if rest.isEmpty():
            return typed
        # other carts: anything sharing an attribute, or of the ranking of items with a known type, or without
        pool = (via(rest, "_type", "_types").unionByName(via(rest, "_cat", "_cats"))
                .unionByName(via(rest, "_gender", "_genders")).unionByName(via(rest, "_brand", "_brands")))
        unknown = F.col("_type") == "unknown"
        ranking = global_row_number(attrs.select("item_id", "price", unknown.alias("_u")), [F.col("_u"), *order], "_n")
        n_known = attrs.where(~unknown).select(F.count("*")).scalar()
        for part, place in ((ranking.where(~F.col("_u")), F.col("_n")), (ranking.where("_u"), F.col("_n") - n_known)):
            listed = fill_from_ranking(rest.select("cart_id"), part.select("item_id", place.alias("pop_rank")), top_n, own, "cart_id")
            pool = pool.unionByName(listed.select("cart_id", "item_id"))
        pool = pool.join(own, ["cart_id", "item_id"], "left_anti")
        return typed.join(enough, "cart_id", "left_semi").unionByName(pool).distinct()

    # in a cart with one price left, cheapness is the same for all priced items, which then rank by id
    flat = sets.join(ranges.where("_hi > _lo"), "cart_id", "left_anti")
    pool = pool_of(sets.join(flat.select("cart_id"), "cart_id", "left_anti"), cheap_order)
    if not flat.isEmpty():
        pool = pool.unionByName(pool_of(flat, [F.desc(pos.cast("int")), F.asc("item_id")]))

    j = pool.join(attrs, "item_id").join(sets, "cart_id").join(ranges, "cart_id", "left")
    scored = j.select("cart_id", "item_id", score.alias("similarity_score"))
    w = Window.partitionBy("cart_id").orderBy(F.desc("similarity_score"), F.asc("item_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


# D17 ------------------------------------------------------------------------
def cart_similarity_scores(carts: DataFrame, sim_table: DataFrame, top_n: int | None = None) -> DataFrame:
    """Similarity rows whose query item is in the cart and similar item is not:
    weight = Σ max(1, qty) of the query item; per similar item
    ranking_score = Σ(sim·w) / Σw, similarity_score = max(sim)."""
    qty = (carts.groupBy("cart_id", "item_id")
           .agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.col("quantity"), F.lit(1)))).alias("_w")))
    s = sim_table.select(F.col("query_id").cast("string").alias("item_id"),
                         F.col("similar_id").cast("string").alias("similar_id"),
                         F.col("similarity_score").cast("double").alias("_sim")).where(
        F.col("similar_id").isNotNull() & F.col("_sim").isNotNull())
    j = qty.join(s, "item_id")
    j = j.join(_cart_ids(carts).withColumnRenamed("item_id", "similar_id"), ["cart_id", "similar_id"], "left_anti")
    agg = j.groupBy("cart_id", "similar_id").agg(
        F.sum(F.col("_sim") * F.col("_w")).alias("weighted_score"),
        F.max("_sim").alias("similarity_score"), F.sum("_w").alias("total_weight"))
    out = agg.select("cart_id", F.col("similar_id").alias("item_id"), "similarity_score",
                     F.when(F.col("total_weight") != 0, F.col("weighted_score") / F.col("total_weight"))
                     .otherwise(F.col("similarity_score")).alias("ranking_score"))
    w = Window.partitionBy("cart_id").orderBy(F.desc("ranking_score"), F.asc("item_id"))
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_n) if top_n else out


# D18 ------------------------------------------------------------------------
def cart_quantity(events: DataFrame) -> DataFrame:
    """Cart state from add_to_cart events: (user, NULL-safe session, item) -> count."""
    sess = F.col("session_id") if "session_id" in events.columns else F.lit(None).cast("string")
    return (events.where(F.col("event_type") == "add_to_cart").withColumn("session_id", sess)
            .groupBy("user_id", "session_id", "item_id")
            .agg(F.count(F.lit(1)).alias("quantity"), F.min("ts").alias("created_at")))


# C11 ------------------------------------------------------------------------
def cart_details(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines with subtotal = int(price) x qty (unknown items skipped) and the cart total."""
    j = carts.join(products.select("item_id", "product_name", "price"), "item_id")
    j = j.withColumn("subtotal", F.col("price").cast("long") * F.col("quantity"))
    return j.withColumn("total", F.sum("subtotal").over(Window.partitionBy("cart_id")))


# G1 -------------------------------------------------------------------------
def cart_then_recs(recs: DataFrame, carts: DataFrame, products: DataFrame) -> DataFrame:
    """Prepend each cart's distinct items (first-add order, rank 0, NULL scores) to
    its non-empty recommendation list; row_type tells them apart. ``position`` numbers
    the rows of a cart, its items first."""
    has_recs = recs.select("cart_id").distinct()
    first = (carts.join(has_recs, "cart_id", "left_semi").groupBy("cart_id", "item_id")
             .agg(F.min("added_at").alias("_first")))
    meta = products.select("item_id", "product_name", "category", "brand", "price")
    cart_rows = first.join(meta, "item_id", "left").select(
        F.lit("cart_item").alias("row_type"), "cart_id", F.lit(0).alias("rank"), "item_id",
        F.coalesce(F.col("product_name"), F.col("item_id")).alias("product_name"),
        F.coalesce(F.col("category"), F.lit("N/A")).alias("category"),
        F.coalesce(F.col("brand"), F.lit("N/A")).alias("brand"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
        F.lit(None).cast("double").alias("similarity_score"), F.lit(None).cast("double").alias("ranking_score"),
        F.row_number().over(Window.partitionBy("cart_id").orderBy("_first", "item_id")).alias("position"))
    rec_rows = recs.select(
        F.lit("recommendation").alias("row_type"), "cart_id", F.col("rank").cast("int"), "item_id",
        "product_name", "category", "brand", "price", "similarity_score", "ranking_score",
        F.col("rank").cast("int").alias("position"))
    sizes = first.groupBy("cart_id").agg(F.count("*").cast("int").alias("_n"))
    rec_rows = rec_rows.join(sizes, "cart_id", "left").withColumn(
        "position", F.col("position") + F.coalesce("_n", F.lit(0))).drop("_n")
    return cart_rows.unionByName(rec_rows)


# G2 -------------------------------------------------------------------------
def personal_plus_global(personal: DataFrame, global_top: DataFrame, products: DataFrame,
                         n_personal: int = 2, n_global: int = 4, cap: int = 4) -> DataFrame:
    """User's top-2 personal items, then global top items not already present,
    catalog items only, at most ``cap`` per user."""
    known = products.select("item_id")
    p = (personal.join(known, "item_id", "left_semi")
         .where(F.col("rank") <= n_personal).select("user_id", "item_id", F.col("rank").alias("_o"),
                                                     F.lit(0).alias("_src")))
    users = personal.select("user_id").distinct()
    g = global_top.join(known, "item_id", "left_semi").where(F.col("rank") <= n_global)
    g_list = g.select(F.collect_list(F.struct("rank", "item_id")).alias("l")).scalar()
    gu = users.select("user_id", F.inline(g_list)).select("user_id", "item_id", F.col("rank").alias("_o"),
                                                          F.lit(1).alias("_src"))
    allr = p.unionByName(gu)
    w1 = Window.partitionBy("user_id", "item_id").orderBy("_src", "_o")
    dedup = allr.withColumn("_k", F.row_number().over(w1)).where("_k = 1")
    w2 = Window.partitionBy("user_id").orderBy("_src", "_o")
    return dedup.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= cap).select(
        "user_id", "item_id", "rank")


# J19 ------------------------------------------------------------------------
def cart_retrieval(carts: DataFrame, products: DataFrame, embeddings: DataFrame, top_k: int = 6,
                   n: int | None = None, history: DataFrame | None = None, cart_weight: float = CART_WEIGHT,
                   popular: bool = True) -> DataFrame:
    """Retrieval for a cart: query = normalise(Σ weight·vector) over the cart's lines
    (``cart_weight`` each) and, with ``history`` (cart_id, item_id, event_type), the
    owner's own events by interaction weight; best items by inner product (no stock / purchase filters), cart
    items removed, first k. Carts without any vector get the popular items, or with
    ``popular=False`` nothing. Each list
    is searched to k plus the cart's own size, so that k are left; ``n`` is a shorter
    first cut."""
    own = _cart_ids(carts)
    items = embeddings.join(products.select("item_id"), "item_id", "left_semi")
    lines = carts.select("cart_id", "item_id").withColumn("w", F.lit(float(cart_weight)))
    if not cart_weight:
        lines = lines.limit(0)
    if history is not None:
        past = history.join(own.select("cart_id").distinct(), "cart_id", "left_semi")
        lines = lines.unionByName(past.select("cart_id", "item_id", weight_of(
            F.col("event_type"), INTERACTION_WEIGHTS, INTERACTION_DEFAULT).cast("double").alias("w")))
    qv = cut_lineage(weighted_vector_sum(lines.join(items, "item_id"), "cart_id").select(
        "cart_id", V.normalize("vector").alias("vector")))
    extra = None if n is not None else own.join(items.select("item_id"), "item_id", "left_semi").groupBy("cart_id").count()
    top = dense_topk(qv, items, top_k if n is None else n, q_key="cart_id", c_key="item_id", q_vec="vector",
                     c_vec="embedding", extra=extra)
    top = top.select(F.col("q_key").alias("cart_id"), F.col("c_key").alias("item_id"),
                     F.col("score").alias("similarity_score")).join(own, ["cart_id", "item_id"], "left_anti")
    w = Window.partitionBy("cart_id").orderBy(F.desc("similarity_score"), F.asc("item_id"))
    out = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    cold_carts = own.select("cart_id").distinct().join(qv.select("cart_id"), "cart_id", "left_anti")
    if not popular or cold_carts.isEmpty():
        return out
    ranking = popular_items(products).select("item_id", "pop_rank")
    cold = fill_from_ranking(cold_carts, ranking if n is None else ranking.where(F.col("pop_rank") <= n), top_k, own, "cart_id")
    return out.unionByName(cold.select("cart_id", "item_id", F.lit(0.0).alias("similarity_score"), "rank"))


# J20 ------------------------------------------------------------------------
SCORES = ("similarity_score", "ranking_score", "model_score")  # a missing one is filled from the one before it


def checkout_fallback_chain(carts: DataFrame, strategies: list) -> DataFrame:
    """First non-empty strategy per cart. strategies: [(name, carts -> recs)];
    each later strategy runs only on the carts all earlier ones left empty.
    recs: (cart_id, item_id, rank, similarity_score[, ranking_score[, model_score]]);
    a score that a strategy has not, or not for a row, is its next weaker one."""
    out = None
    remaining = cut_lineage(carts)  # read by each strategy
    for name, fn in strategies:
        if out is not None and remaining.isEmpty():
            break  # every cart is served; later strategies would only add empty plans
        # each strategy's result is materialised in the shared checkpoint folder so
        # the next strategy's input (carts still empty) does not recompute it
        df = cut_lineage(fn(remaining))
        filled, before = [], F.lit(None).cast("double")
        for score in SCORES:
            before = F.coalesce(F.col(score).cast("double"), before) if score in df.columns else before
            filled.append(before.alias(score))
        d = df.select("cart_id", "item_id", "rank", *filled).withColumn("strategy", F.lit(name))
        out = d if out is None else out.unionByName(d)
        remaining = cut_lineage(remaining.join(d.select("cart_id").distinct(), "cart_id", "left_anti"))
    return out


# B11 / G4 -------------------------------------------------------------------
def prepare_events(events: DataFrame, carts: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """Conform an event log for the ranker and append the open cart as events.

    event_time / created_at are accepted as the time column, ids become text,
    unparsable times are dropped; each cart's distinct items (first-add order)
    become add_to_cart events at as_of - (n - i) minutes (as_of defaults to the
    log's latest time, never the wall clock)."""
    e = events
    if "ts" not in e.columns:
        src = next((c for c in ("timestamp", "event_time", "created_at") if c in e.columns), None)
        if src is None:
            raise ValueError("events need a timestamp / event_time / created_at column")
        e = e.withColumnRenamed(src, "ts")
    e = (e.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"),
                                       F.try_to_timestamp(F.col("ts").cast("string"))))
         .where(F.col("ts").isNotNull())
         .withColumn("user_id", F.col("user_id").cast("string")).withColumn("item_id", F.col("item_id").cast("string")))
    e = e.select("user_id", "item_id", "event_type", "ts", F.lit(False).alias("synthetic"))
    if carts is None:
        return e
    now = as_of if as_of is not None else e.select(F.max("ts")).scalar()
    first = carts.groupBy(F.col("cart_id").cast("string").alias("user_id"), F.col("item_id").cast("string")
                          .alias("item_id")).agg(F.min("added_at").alias("_first"))
    w = Window.partitionBy("user_id").orderBy("_first", "item_id")
    first = first.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(
        Window.partitionBy("user_id")))
    synth = first.select("user_id", "item_id", F.lit("add_to_cart").alias("event_type"),
                         (now - F.make_interval(mins=(F.col("_n") - F.col("_i")).cast("int"))).alias("ts"),
                         F.lit(True).alias("synthetic"))
    return e.unionByName(synth)


# J18 ------------------------------------------------------------------------
def checkout_recs(carts: DataFrame, products: DataFrame, embeddings: DataFrame, events: DataFrame,
                  top_k: int = 6, scorer=None, recency_days: int = CHECKOUT_RECENCY_DAYS) -> DataFrame:
    """Ranker-scored checkout recommendations for every cart.

    Candidates: the best N = max(5k, 30) for the owner's own recent events and the
    cart (its lines are add_to_cart events) that are not in the cart (no stock /
    purchase filters); a cart for which that finds nothing takes metadata
    candidates, and its features come without embeddings. Features from the
    owner's events with the cart among them; score (default linear) x trending
    boost; blend 0.70 * minmax(similarity) + 0.30 * minmax(model) per cart; <= 3
    per category; top k."""
    n = max(top_k * 5, 30)
    carts = cut_lineage(carts)
    ev = cut_lineage(prepare_events(events, carts).drop("synthetic"))
    owners = carts.select(F.col("cart_id").cast("string").alias("user_id")).distinct()
    # the cart's lines are events already, so they come with the history
    history = recent_events(ev, recency_days).join(owners, "user_id", "left_semi") \
        .select(F.col("user_id").alias("cart_id"), "item_id", "event_type")
    retr = cut_lineage(cart_retrieval(carts, products, embeddings, top_k=n, history=history, cart_weight=0.0))
    left = carts.join(retr.select("cart_id").distinct(), "cart_id", "left_anti")

    def features(cands: DataFrame, vectors: DataFrame) -> DataFrame:
        cands = cands.select(F.col("cart_id").alias("user_id"), "item_id", "similarity_score")
        return build_features(cands, ev, products, vectors, recency_days).withColumn(
            "similarity_score", F.col("retrieval_similarity"))

    feats = features(retr, embeddings)
    if not left.isEmpty():
        feats = feats.unionByName(features(cut_lineage(metadata_candidates(products, left, n)), embeddings.limit(0)))
    scored = scorer(feats) if scorer else feats.withColumn("raw_score", linear_score())
    scored = trending_boost(scored, products, "raw_score", "model_score")
    scored = minmax_norm(scored, "similarity_score", "_sn")
    scored = minmax_norm(scored, "model_score", "_mn")
    scored = scored.withColumn("ranking_score", F.lit(BLEND_SIMILARITY) * F.col("_sn")
                               + F.lit(BLEND_MODEL) * F.col("_mn"))
    top = diversity_rerank(scored, products, top_k, "ranking_score")
    return top.select(F.col("user_id").alias("cart_id"), "item_id", "rank", "similarity_score", "model_score",
                      "ranking_score")
