"""Behavioural interaction analytics on Spark: point-in-time features, sampling,
per-action models and per-user-AUC scoring, all as DataFrame jobs."""

from actionloom.spec import FeatureSpec

__all__ = ["FeatureSpec"]
