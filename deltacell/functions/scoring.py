"""Suitability score of a study site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the score terms.
WEIGHTS = {"forest": 0.30, "chain": 0.25, "size": 0.15, "water": 0.10, "slope": 0.10, "width": 0.05, "gust": 0.05}
BONUS = 0.05
CHAIN_VALUE = {"full": 1.0, "stretched": 0.6, "partial": 0.3}


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score_terms(
    area_km2: Column, width_m: Column, gust: Column, storm_type: Column, quality: Column,
    forest_frac: Column, water_frac: Column, slope_deg: Column,
) -> dict[str, Column]:
    """Unweighted terms. Slope is not capped above and gust not floored below, as published."""
    chain = F.lit(0.0)
    for name, value in CHAIN_VALUE.items():
        chain = F.when(quality == name, value).otherwise(chain)
    return {
        "forest": F.coalesce(forest_frac, F.lit(0.5)),
        "chain": chain,
        "size": F.least(F.lit(1.0), F.coalesce(area_km2, F.lit(0.0)) / 4.0),
        "water": F.when(water_frac.isNull(), 1.0).otherwise(
            F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), water_frac * 10))
        ),
        "slope": F.when(slope_deg.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (slope_deg - 3.0) / 5.0)),
        "width": _clamp((F.coalesce(width_m, F.lit(0.0)) - 150) / 350.0),
        "gust": F.when(gust > 0, F.least(F.lit(1.0), (gust - 15) / 15.0)).otherwise(0.5),
        "bonus": F.when(storm_type == "tornado", BONUS).otherwise(0.0),
    }


def suitability(terms: dict[str, Column]) -> tuple[Column, Column]:
    """Score rounded to three places and the struct of its weighted parts."""
    weighted = {k: terms[k] * w for k, w in WEIGHTS.items()}
    total = terms["bonus"]
    for c in weighted.values():
        total = total + c
    parts = [F.round(c, 3).alias(k) for k, c in weighted.items()] + [terms["bonus"].alias("tornado_bonus")]
    return F.round(total, 3), F.struct(*parts)
