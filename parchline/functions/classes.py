"""Drought severity, trend category and sign classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the severity classes, wettest first.
SEVERITY_BOUNDS = (("Normal/Wet", 0.0), ("D0", -0.8), ("D1", -1.3), ("D2", -1.6), ("D3", -2.0))
DRIEST = "D4"
SEVERITIES = tuple(name for name, _ in SEVERITY_BOUNDS) + (DRIEST,)
NO_DATA = "No Data"
NOT_DROUGHT = "N/A"
TREND_ALPHA = 0.05

# Labels of the three trend categories.
TREND_LABELS = {
    "none": ("No Significant Trend", "بدون روند معنی‌دار", "—"),
    "inc": ("Increasing Trend (Wetter)", "روند افزایشی (مرطوب‌تر)", "↑"),
    "dec": ("Decreasing Trend (Drier)", "روند کاهشی (خشک‌تر)", "↓"),
}
# Labels without a wet/dry reading, for indices that are not drought indices.
NEUTRAL_TREND_LABELS = {"inc": "روند افزایشی", "dec": "روند کاهشی"}


def is_drought_index(name: str) -> bool:
    """Server rule: the name starts with a drought family."""
    return str(name or "").lower().startswith(("spi", "spei"))


def severity(value: Column) -> Column:
    """Severity class of an index value; null stays null."""
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, bound in SEVERITY_BOUNDS:
        chain = chain.when(value >= bound, F.lit(name))
    return chain.otherwise(F.lit(DRIEST))


def map_severity(value: Column, index_name: str) -> Column:
    """Severity shown on a map: no value, not a drought index, or a class."""
    shown = severity(value) if is_drought_index(index_name) else F.lit(NOT_DROUGHT)
    return F.when(value.isNull(), F.lit(NO_DATA)).otherwise(shown)


def trend_category(slope: Column, p_value: Column, alpha: float = TREND_ALPHA) -> Column:
    p = F.when(p_value.isNull() | F.isnan(p_value) | (F.abs(p_value) == float("inf")), 1.0).otherwise(p_value)
    s = F.coalesce(slope, F.lit(0.0))
    return (
        F.when(p > alpha, "none").when(s > 0, "inc").when(s < 0, "dec").otherwise("none")
    )


def _label(category: Column, position: int) -> Column:
    chain = F
    for name, labels in TREND_LABELS.items():
        chain = chain.when(category == name, F.lit(labels[position]))
    return chain


def trend_label_en(category: Column) -> Column:
    return _label(category, 0)


def trend_label_fa(category: Column) -> Column:
    return _label(category, 1)


def trend_symbol(category: Column) -> Column:
    return _label(category, 2)


def trend_label_for_index(category: Column, index_name: str) -> Column:
    """Label text; neutral wording when the index is not a drought index."""
    label = trend_label_fa(category)
    if is_drought_index(index_name):
        return label
    for name, text in NEUTRAL_TREND_LABELS.items():
        label = F.when(category == name, F.lit(text)).otherwise(label)
    return label


def sign_class(value: Column) -> Column:
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite & (value > 0), "positive").when(finite & (value < 0), "negative").otherwise("neutral")
