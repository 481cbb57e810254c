"""Expressions over packed id lists such as ``1;5`` and ``12 0.7;5 0.6``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actionloom.spec import MISSING_KEYWORDS, MISSING_TAGS, MISSING_WEIGHTED_TAGS, TAG_THRESHOLD


def _plain_ids(text: Column) -> Column:
    return F.transform(F.split(text, ";"), lambda x: x.cast("int"))


def _trusted_ids(text: Column, threshold: float) -> Column:
    pairs = F.transform(F.split(text, ";"), lambda x: F.split(F.trim(x), " "))
    kept = F.filter(pairs, lambda p: F.get(p, F.lit(1)).cast("double") > threshold)
    return F.transform(kept, lambda p: F.get(p, F.lit(0)).cast("int"))


def _merge(manual: Column, machine: Column, manual_ids: Column, machine_ids: Column) -> Column:
    nothing = F.array().cast("array<int>")
    left = F.when(manual == "", nothing).otherwise(manual_ids)
    right = F.when(machine == "", nothing).otherwise(machine_ids)
    both_blank = (manual == "") & (machine == "")
    ids = F.when(both_blank, F.array(F.lit(-1))).otherwise(F.array_union(left, right))
    return F.array_sort(F.transform(ids, lambda x: x + 1))


def merge_keywords(manual: Column, machine: Column) -> Column:
    """Sorted union of both keyword lists, every id moved up by one.

    A missing side counts as the unknown keyword, which becomes 0; a blank side counts
    as nothing, and two blank sides as the unknown keyword.
    """
    manual = F.coalesce(manual, F.lit(MISSING_KEYWORDS))
    machine = F.coalesce(machine, F.lit(MISSING_KEYWORDS))
    return _merge(manual, machine, _plain_ids(manual), _plain_ids(machine))


def merge_tags(manual: Column, machine: Column, threshold: float = TAG_THRESHOLD) -> Column:
    """As :func:`merge_keywords`, with machine tags kept only above the threshold."""
    manual = F.coalesce(manual, F.lit(MISSING_TAGS))
    machine = F.coalesce(machine, F.lit(MISSING_WEIGHTED_TAGS))
    return _merge(manual, machine, _plain_ids(manual), _trusted_ids(machine, threshold))
