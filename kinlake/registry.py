"""What a run can be made of.  Each table is open: add an entry to extend it."""

from __future__ import annotations

from kinlake.functions.similarity import SIMILARITIES
from kinlake.operators.grouping import CLUSTERERS, COMMUNITIES
from kinlake.operators.supervised import MODELS

BLOCKING = ("none", "standard", "prefix", "sn", "embed")
CLASSIFIERS = ("threshold", *MODELS, *COMMUNITIES)

__all__ = ["BLOCKING", "CLASSIFIERS", "CLUSTERERS", "COMMUNITIES", "MODELS", "SIMILARITIES"]
