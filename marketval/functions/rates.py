"""Rates, ratios and the predicates built on them. Nothing here rounds."""

from pyspark.sql import Column, functions as F

from marketval.constants import (
    CAUTION_MAX_RATIO,
    CLAIM_PRICE_TOLERANCE,
    DATE_TOLERANCE_DAYS,
    SAME_PRICE_TOLERANCE,
    SAME_SIZE_TOLERANCE,
    SHORTLIST_MIN_CLOSINGS,
    SHORTLIST_MIN_RATIO,
    SQFT_PER_ACRE,
)


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def acres_to_sqft(acres: Column) -> Column:
    return acres * F.lit(SQFT_PER_ACRE)


def metric_size(metric: Column, lot: Column, living: Column) -> Column:
    """The size a profile prices on; NULL for a metric that is neither size."""
    return F.when(metric == "lot_sqft", lot).when(metric == "living_sqft", living)


def per_sqft(price: Column, size: Column) -> Column:
    """Price per square foot; missing when either figure is missing or zero."""
    return F.try_divide(nonzero(price), nonzero(size))


def sold_to_ask(sold: Column, final_list: Column) -> Column:
    return F.try_divide(nonzero(sold), nonzero(final_list))


def was_reduced(original_list: Column, final_list: Column) -> Column:
    return F.coalesce(original_list > final_list, F.lit(False))


def in_core(rate: Column, low: Column, high: Column) -> Column:
    """Inside the core bounds, both ends included; either bound may be open."""
    return F.coalesce(
        rate.isNotNull()
        & (rate >= F.coalesce(low, rate))
        & (rate <= F.coalesce(high, rate)),
        F.lit(False),
    )


def bracket_bounds(size: Column, tolerance: Column, low: Column, high: Column) -> Column:
    """struct(low, high) around a subject size, or the pinned range."""
    pinned = low.isNotNull() & high.isNotNull()
    return F.struct(
        F.when(size.isNull(), None).when(pinned, low).otherwise(size * (1 - tolerance)).alias("low"),
        F.when(size.isNull(), None).when(pinned, high).otherwise(size * (1 + tolerance)).alias("high"),
    )


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Three-valued: NULL when either figure is missing."""
    gap = F.abs(a - b) / nonzero(F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), None).otherwise(
        (a == b) | F.coalesce(gap <= tolerance, F.lit(False))
    )


def same_sale(price_a: Column, size_a: Column, price_b: Column, size_b: Column) -> Column:
    """Two rows at one address are one sale unless price or lot size contradicts it."""
    return F.coalesce(close(price_a, price_b, SAME_PRICE_TOLERANCE), F.lit(True)) & F.coalesce(
        close(size_a, size_b, SAME_SIZE_TOLERANCE), F.lit(True)
    )


def completeness(columns: list[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def prices_match(known: Column, claimed: Column) -> Column:
    """Relative to the known price; a missing side never matches."""
    return F.coalesce(
        F.when(known == 0, claimed == 0).otherwise(
            F.abs(known - claimed) / F.abs(nonzero(known)) <= CLAIM_PRICE_TOLERANCE
        ),
        F.lit(False),
    )


def dates_match(known: Column, claimed: Column, days: int = DATE_TOLERANCE_DAYS) -> Column:
    return F.coalesce(F.abs(F.datediff(known, claimed)) <= days, F.lit(False))


def interview_flag(closings: Column, mean_ratio: Column, any_reduced: Column) -> Column:
    return (
        F.when(mean_ratio.isNull(), "")
        .when((closings >= SHORTLIST_MIN_CLOSINGS) & (mean_ratio >= SHORTLIST_MIN_RATIO), "shortlist")
        .when(any_reduced & (mean_ratio < CAUTION_MAX_RATIO), "caution")
        .otherwise("")
    )


def ratio_percent(ratio: Column) -> Column:
    """A ratio as a signed percentage: 1.007 is +0.7."""
    return (ratio - 1.0) * 100.0
