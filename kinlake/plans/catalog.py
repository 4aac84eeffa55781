"""All registered queries."""

from __future__ import annotations

from kinlake.plans import q_blocking, q_budget, q_grouping, q_metrics, q_models, q_profile, q_segment, q_similarity, q_text, q_truth  # noqa: F401
from kinlake.plans.entries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
