"""Names of datasets, indices, models and methods (driver-side helpers plus a few columns)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_KEYS = ("dataset_key", "feature_id", "date")
DATASET_KEY_PATTERN = r"^[A-Za-z0-9_]+$"

# Forecast methods with rank and label, retired methods, interval labels. The methods made here come
# after those that other systems store.
DEFAULT_METHOD = "lstm_attention"
METHOD_RANK = {"lstm_attention": 0, "random_forest": 1, "xgboost": 2, "boosted_trees": 3, "window_regression": 4}
UNRANKED = 99
METHOD_LABELS = {
    "lstm_attention": "LSTM + Attention", "random_forest": "Random Forest", "xgboost": "XGBoost", "boosted_trees": "Boosted Trees",
    "window_regression": "Window Regression",
}
INTERVAL_LABELS = {
    "backtest_q90": "Backtest Q90",
    "rmse_164": "RMSE x 1.64",
    "historical_spread": "Historical Spread",
    "sigma_model": "Sigma Model",
}
DEFAULT_INTERVAL = "backtest_q90"
RETIRED_METHODS = ("garch", "sarimax", "elastic_net_ar")
FORECAST_FAMILIES = ("spi", "spei", "ssi")


def valid_dataset_key(key: str) -> str:
    cleaned = (key or "").strip()
    if not re.match(DATASET_KEY_PATTERN, cleaned):
        raise ValueError(f"Invalid dataset key: {key!r}")
    return cleaned


def same_key(column: Column, key: str) -> Column:
    """Case-insensitive match of a validated dataset key."""
    return F.lower(column) == valid_dataset_key(key).lower()


def index_columns(columns: Iterable[str]) -> list[str]:
    """Index columns of a wide series table: everything that is not a key."""
    return sorted(c for c in columns if c not in SERIES_KEYS)


def require_index(columns: Iterable[str], index_name: str) -> str:
    wanted = (index_name or "").strip().lower()
    known = index_columns(columns)
    if wanted not in known:
        raise ValueError(f"no index column {wanted!r}; the series has {', '.join(known) or 'none'}")
    return wanted


def loose_index(columns: Iterable[str], index_name: str) -> str | None:
    """Find a column ignoring case, dashes and underscores."""
    def bare(name: str) -> str:
        return name.strip().lower().replace("-", "").replace("_", "")

    names = list(columns)
    exact = (index_name or "").strip().lower()
    if exact in names:
        return exact
    return {bare(n): n for n in names}.get(bare(index_name or ""))


def loose_name(column: Column) -> Column:
    """A name as ``loose_index`` compares it."""
    return F.translate(F.lower(F.trim(column)), "-_", "")


def resolved_index(column: Column, known: Iterable[str]) -> Column:
    """The known index each requested name means, exact matches first, else null."""
    names = list(known)
    exact = F.lower(F.trim(column))
    loose = F
    for name in reversed(names):
        loose = loose.when(loose_name(column) == name.strip().lower().replace("-", "").replace("_", ""), F.lit(name))
    return F.when(exact.isin(*names), exact).otherwise(loose)


def requested_indices(catalog: Iterable[str], names: Iterable[str] = (), scales: object = None) -> list[str]:
    """The index columns that a forecast run takes.

    ``names`` and the indices of ``scales`` (whole months from one on) are taken in the order asked for, once each; a run that asks for neither
    takes every column of ``catalog`` that belongs to a drought family.
    """
    asked = dict.fromkeys(name.strip().lower() for name in names if name.strip())
    if scales is not None:
        asked.update(dict.fromkeys(named_at("spi" + SCALE_PLACE, months) for months in checked_scales(scales)))
    return list(asked) or [column for column in catalog if drought_family(column)]


def drought_family(column: str) -> bool:
    return any(column.startswith(family) for family in FORECAST_FAMILIES)


def index_family(name: Column) -> Column:
    """Rank of an index family; names without a window come last."""
    family = F.regexp_extract(F.lower(name), r"^(spi|spei|ssi)(\d+)$", 1)
    return F.when(family == "spi", 0).when(family == "spei", 1).when(family == "ssi", 2).otherwise(3)


def index_window(name: Column) -> Column:
    digits = F.regexp_extract(F.lower(name), r"^(spi|spei|ssi)(\d+)$", 2)
    return F.coalesce(digits.try_cast("bigint"), F.lit(9007199254740991))


DEFAULT_SCALES = (3,)
SCALE_PLACE = "{scale}"


def checked_scales(given: object) -> tuple[int, ...]:
    """Window lengths in months, distinct and ascending; only whole numbers from one on are taken."""
    if given is None:
        return DEFAULT_SCALES
    months = [given] if isinstance(given, (int, str)) else list(given)
    wrong = [m for m in months if isinstance(m, bool) or not isinstance(m, int) or m < 1]
    if wrong or not months:
        raise ValueError(f"scales must be whole months above zero, not {wrong or 'nothing'}")
    return tuple(sorted(set(months)))


def scale_place(name: str, append: bool = False) -> str:
    """A name with a place for the scale: where an older name holds one, or (``append``) behind it."""
    if SCALE_PLACE in name:
        return name
    pieces = re.split(r"(?i)(?<=spi)(-?)\d+(?![0-9A-Za-z_])", name)
    if len(pieces) > 1:
        # Every second piece is the dash of a place, or nothing.
        return "".join(piece if i % 2 == 0 else piece + SCALE_PLACE for i, piece in enumerate(pieces))
    return f"{name}_spi{SCALE_PLACE}" if append and name else name


def named_at(template: str, scale: int) -> str:
    return template.replace(SCALE_PLACE, str(scale))


def model_key(source_key: str, index_name: str, method: str) -> str:
    return f"{source_key}_{index_name}_{method}".replace("-", "_").lower()


def normalized_method(method: Column) -> Column:
    """Trimmed lower-case method; blanks become the default method."""
    return F.coalesce(F.nullif(F.lower(F.trim(method)), F.lit("")), F.lit(DEFAULT_METHOD))


def method_rank(method: Column) -> Column:
    chain = F
    for name, rank in METHOD_RANK.items():
        chain = chain.when(method == name, F.lit(rank))
    return chain.otherwise(F.lit(UNRANKED))


def _labelled(name: Column, labels: dict[str, str], default: str) -> Column:
    key = F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit(default))
    chain = F
    for known, label in labels.items():
        chain = chain.when(key == known, F.lit(label))
    return chain.otherwise(F.initcap(F.translate(key, "_", " ")))


def method_label(method: Column) -> Column:
    return _labelled(method, METHOD_LABELS, DEFAULT_METHOD)


def interval_label(interval: Column) -> Column:
    return _labelled(interval, INTERVAL_LABELS, DEFAULT_INTERVAL)


def is_retired(method: Column, key: Column | None = None, dated: bool = False) -> Column:
    """Rows of retired methods, found by name or by the ending of a model key.

    A version key (``dated``) has a time stamp after the method. Elsewhere in a key such a word is part of a
    source's name.
    """
    hit = F.coalesce(method.isin(*RETIRED_METHODS), F.lit(False))
    if key is not None:
        ending = rf"_({'|'.join(RETIRED_METHODS)})" + (r"_[0-9]{8}T[0-9]{6}Z$" if dated else "$")
        hit = hit | F.coalesce(key.rlike(ending), F.lit(False))
    return hit
