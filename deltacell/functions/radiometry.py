"""Per-cell value conversions and predicates. Every function takes and returns Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltacell import schema as S


def clean(value: Column, *sentinels: float) -> Column:
    """NULL for NaN and for each registered no-data value."""
    bad = F.isnan(value)
    for s in sentinels:
        bad = bad | (value == F.lit(float(s)))
    return F.when(~bad, value)


def to_db(value: Column, power: int = 1) -> Column:
    """10*log10(value), or 20*log10 for ``power=2``; zero and below are NULL."""
    return F.when(value > 0, F.lit(10.0 * power) * F.log10(value))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def negative_share(value: Column) -> Column:
    """Aggregate: share of finite values that can only be decibels. No finite value gives NULL."""
    physical = (value < 0) & (value > S.DB_FLOOR)
    return F.try_divide(F.count(F.when(physical, 1)), F.count(value))


def is_db(value: Column) -> Column:
    """Aggregate flag: the group already holds decibels."""
    return F.coalesce(negative_share(value) > S.DB_NEGATIVE_SHARE, F.lit(False))


def to_db_domain(value: Column, already_db: Column, power: int = 1) -> Column:
    return F.when(already_db, F.when(value > S.DB_FLOOR, value)).otherwise(to_db(value, power))


def sane_coherence(value: Column, nodata: float | None = None) -> Column:
    low, high = S.COHERENCE_RANGE
    keep = value.between(low, high)
    if nodata is not None:
        keep = keep & (value != F.lit(float(nodata)))
    return F.when(keep, value)


def valid_coherence(target: Column, control: Column, rule: str) -> Column:
    """Validity rules used by the research runs, by name."""
    rules = {
        "pair": target > 0,
        "finite": target.isNotNull() & control.isNotNull(),
        "both_positive": (target > 0) & (control > 0),
        "open_unit": (target > 0) & (target < 1),
    }
    if rule not in rules:
        raise ValueError(f"unknown validity rule: {rule}")
    return rules[rule]


def coherence_score(target: Column, baseline: Column | None, mode: str = "event_drop") -> Column:
    """Positive where coherence fell (``event_drop``) or rose (``persistent_gain``)."""
    if mode not in ("event_drop", "persistent_gain"):
        raise ValueError(f"unknown coherence mode: {mode}")
    if baseline is None:
        return F.lit(1.0) - target
    return baseline - target if mode == "event_drop" else target - baseline


def above(value: Column, threshold: Column | float) -> Column:
    """Strictly above, as the detectors flag; NULL is never flagged."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(value > limit, F.lit(False))


def any_band_water(db: Column, threshold_db: float = -20.0) -> Column:
    """Aggregate over the bands of a cell: true when one band is strictly below the threshold."""
    return F.bool_or(F.coalesce(db < threshold_db, F.lit(False)))


def is_land(flag: Column, land_value: int = 1) -> Column:
    """``land_value`` is 1 for current products and 0 under the older convention."""
    return F.coalesce(flag == land_value, F.lit(False))


def in_classes(cls: Column, classes: Iterable[int] = S.TREE_CLASSES) -> Column:
    return F.coalesce(cls.isin(*classes), F.lit(False))


def _no_loss_before(loss: Column, code: Column) -> Column:
    return (code <= 0) | (loss == 0) | (loss >= code)


def forest_candidate(cover: Column, loss: Column, year: Column | int, tau: Column | int = S.COVER_TAU) -> Column:
    """Forest before year Y; loss dated in Y itself stays inside."""
    code = (F.lit(year) if isinstance(year, int) else year) - 2000
    return (cover >= tau) & _no_loss_before(loss, code)


def forest_background(cover: Column, loss: Column, year: Column | int, tau: Column | int = S.COVER_TAU) -> Column:
    """As :func:`forest_candidate` but loss dated in Y is outside too."""
    code = (F.lit(year) if isinstance(year, int) else year) - 2000
    return (cover >= tau) & ((code <= 0) | (loss == 0) | (loss >= code + 1))


def loss_in_year(cover: Column, loss: Column, year: Column | int, tau: Column | int = S.COVER_TAU) -> Column:
    code = (F.lit(year) if isinstance(year, int) else year) - 2000
    return (loss == code) & (cover >= tau)
