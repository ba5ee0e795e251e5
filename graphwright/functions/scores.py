"""Small column helpers: clamps and severity bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def binned(x: Column, bins: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The name of the first bin whose threshold x reaches (strict: exceeds); bins from the highest down."""
    out = F.lit(otherwise)
    for threshold, name in reversed(bins):
        out = F.when(x > threshold if strict else x >= threshold, name).otherwise(out)
    return out


#: Severity thresholds of the surfaces that show a risk score.
SEVERITY = [(80, "critical"), (60, "high"), (40, "medium")]
SEVERITY_PAGE = [(75, "critical"), (50, "high"), (25, "medium")]
FAN_IN_SEVERITY = [(20, "critical"), (12, "high")]
COMPLEXITY = [(70, "High"), (30, "Moderate")]
COUPLING = [(60, "high"), (35, "medium")]


def severity(score: Column) -> Column:
    return binned(score, SEVERITY, "low")


def page_severity(score: Column) -> Column:
    """Severity on the page of a single change, whose thresholds must be exceeded."""
    return binned(score, SEVERITY_PAGE, "low", strict=True)


def coupling(score: Column) -> Column:
    return binned(score, COUPLING, "low")


def understanding(steps: Column) -> Column:
    """How much of the code a reader knows after so many steps, in percent."""
    return clamp(45 + 10 * steps, 50, 90)


def relevance(percent: Column) -> Column:
    """A score in percent as a share; null is none."""
    return clamp(F.coalesce(percent, F.lit(0)) / 100.0, 0.0, 1.0)
