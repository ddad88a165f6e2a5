"""All registered queries (importing a module registers its queries)."""

from __future__ import annotations

from shoplens.plans import q_analytics, q_cf, q_checkout, q_dialog, q_files, q_online, q_profiles, q_ranking, q_scalars, q_search, q_sequences, q_sources, q_streaming, q_vectors  # noqa: F401
from shoplens.plans.base import REGISTRY

__all__ = ["REGISTRY"]
