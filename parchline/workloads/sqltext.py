"""SQL text of formulas used in several checks."""

from __future__ import annotations

from ..functions.classes import DRIEST, SEVERITY_BOUNDS
from ..functions import normal as N


def severity(value: str) -> str:
    whens = " ".join(f"WHEN {value} >= {bound}::DOUBLE THEN '{name}'" for name, bound in SEVERITY_BOUNDS)
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{DRIEST}' END"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_quantile(p: str) -> str:
    """Quantile of a probability column, as one expression."""
    c = f"greatest(1e-12, least(1 - 1e-12, {p}))"
    q = f"({c} - 5e-1)"
    r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {c} ELSE 1 - {c} END))"
    s = f"(0.180625::DOUBLE - {q} * {q})"
    mid, far = f"({r} - 16e-1)", f"({r} - 5e0)"
    ratio = lambda x, a, b: f"{polynomial(x, a)} / {polynomial(x, b)}"
    tail = (
        f"CASE WHEN {r} <= 5 THEN {ratio(mid, N.MIDDLE_NUM, N.MIDDLE_DEN)} ELSE {ratio(far, N.TAIL_NUM, N.TAIL_DEN)} END"
    )
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN abs({q}) <= 0.425::DOUBLE THEN {q} * {polynomial(s, N.CENTRAL_NUM)} / {polynomial(s, N.CENTRAL_DEN)} "
        f"ELSE sign({q}) * ({tail}) END"
    )


def two_sided_p(z: str) -> str:
    """Two-sided normal tail probability, by the series of the CDF."""
    series = (
        f"list_sum(list_transform(range(0, 120), lambda k: pow(abs({z}), 2 * k + 1) * sqrt(pi()) / (pow(2e0, k + 1) * gamma(k + 15e-1))))"
    )
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0e0, 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}) END"


def standardized(source: str, keys: str, scale: int, minimum_years: int, reference: str = "TRUE", value: str = "value") -> str:
    """Statements from a complete monthly series to its index, as CTE text.

    ``source`` must have the keys, date and value; ends in a CTE named ``indexed``.
    """
    return f"""
    rolled AS (
        SELECT *, CASE WHEN count({value}) OVER w = {scale} THEN sum({value}) OVER w END AS total,
               min({value}) OVER (PARTITION BY {keys}) AS lowest, {reference} AS in_reference
        FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
    ranked AS (
        SELECT *, count(*) FILTER (WHERE in_reference AND total IS NOT NULL) OVER (PARTITION BY {keys}, month(date) ORDER BY total
                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place,
               count(*) FILTER (WHERE in_reference AND total IS NOT NULL) OVER (PARTITION BY {keys}, month(date)) AS size
        FROM rolled),
    placed AS (
        SELECT *, CASE WHEN total IS NOT NULL AND size >= {minimum_years} AND coalesce(lowest, 0) >= 0
                       THEN (greatest(place, 1) - 0.44::DOUBLE) / (size + 0.12::DOUBLE) END AS p FROM ranked),
    indexed AS (SELECT *, {normal_quantile("p")} AS idx FROM placed)"""


def common_months(source: str, keys: str, value: str = "value") -> str:
    """CTE ``complete``: every series on all months from the first to the last."""
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = f.{k}" for k in names)
    return f"""
    complete AS (
        SELECT {", ".join("f." + k for k in names)}, m.date, s.{value}
        FROM (SELECT DISTINCT {keys} FROM {source}) f
        CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM {source}), (SELECT max(date) FROM {source}),
                    INTERVAL 1 MONTH)) AS DATE) AS date) m
        LEFT JOIN {source} s ON {on} AND s.date = m.date)"""
