"""Event weight maps and other values that must equal the reference's.

The reference uses five different event->weight maps; each one is a separate
semantic and they are deliberately not unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) --------------------------------
# label weight used for ranking labels (unknown -> 0)
LABEL_WEIGHTS = {"purchase": 3, "add_to_cart": 2, "click": 1, "view": 0}
# weight of each event in a retrieval query vector (unknown -> 0.5)
INTERACTION_WEIGHTS = {"purchase": 3.0, "add_to_cart": 2.0, "click": 1.0, "view": 0.5}
INTERACTION_DEFAULT = 0.5
# collaborative-filter event score (unknown, including purchase -> 0)
CF_SCORES = {"view": 1, "click": 2, "add_to_cart": 3, "time_spent": 2}
# weight of a sequence-model training target (unknown -> 1.0)
TARGET_WEIGHTS = {"purchase": 3.0, "add_to_cart": 2.0, "click": 1.0, "view": 0.25}
TARGET_DEFAULT = 1.0
# event-type ids of the sequence model: pad 0, unknown -> 4
EVENT_TYPE_IDS = {"click": 1, "add_to_cart": 2, "purchase": 3, "view": 4}
EVENT_TYPE_UNKNOWN = 4

RECENCY_DAYS = 90
CHECKOUT_RECENCY_DAYS = 365
SEQ_LOOKBACK_DAYS = 180
SEQ_MAX_LEN = 50
SEQ_MIN_HISTORY = 2
TRENDING_QUANTILE = 0.80
TRENDING_BOOST = 1.10
MAX_PER_CATEGORY = 3
BLEND_SIMILARITY = 0.70
BLEND_MODEL = 0.30
DECAY_PER_HOUR = 0.995
ONLINE_ALPHA = 0.15
ONLINE_HISTORY = 50
PAIR_TTL_SECONDS = 604800
# scores of the attribute rules for carts
RULE_SAME_TYPE, RULE_UNKNOWN_TYPE, RULE_OTHER_TYPE, RULE_SHARED_TYPE = 8.0, -3.0, -2.0, 4.0
RULE_CATEGORY, RULE_GENDER, RULE_BRAND = 2.0, 0.8, 0.6
HYBRID_BM25_WEIGHT = 0.4
HYBRID_SEMANTIC_WEIGHT = 0.6
HYBRID_CANDIDATE_K = 50
# -----------------------------------------------------------------------------


def weight_of(event_type: Column, mapping: dict, default) -> Column:
    """Literal map lookup with a default for unmapped / NULL event types."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(event_type == k, F.lit(v)) if expr is None
                else expr.when(event_type == k, F.lit(v)))
    return expr.otherwise(F.lit(default))


def weight_sql(col: str, mapping: dict, default) -> str:
    """The same lookup as a SQL CASE expression (oracle side)."""
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"(CASE {col} {arms} ELSE {default} END)"
