"""Score formulas: ranking boosts, fraud and fake-review rules, demand and price arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.rounding import round_exact


def rating_boost(rating: Column, weight: float) -> Column:
    return F.lit(float(weight)) * ((rating - 1) / 4)


def popularity_boost(rating_count: Column, weight: float, max_count: int = fixed.MAX_RATING_COUNT) -> Column:
    share = F.log10(rating_count + F.lit(1)) / F.log10(F.lit(max_count + 1))
    return F.lit(float(weight)) * F.least(F.lit(1.0), share)


def velocity_indicator(nearby: Column) -> Column:
    return F.when(nearby >= 3, 1.0).when(nearby == 2, 0.6).when(nearby == 1, 0.3).otherwise(0.0)


def region_risk(shipping: Column, billing: Column, account_age_days: Column,
                new_account_days: int = fixed.NEW_ACCOUNT_DAYS) -> Column:
    return (
        F.when(shipping == billing, 0.0).when(account_age_days <= new_account_days, 1.0).otherwise(0.4)
    )


def new_account_high_value(account_age_days: Column, amount: Column,
                           new_account_days: int = fixed.NEW_ACCOUNT_DAYS,
                           high_value: float = fixed.HIGH_VALUE_AMOUNT) -> Column:
    return F.when((account_age_days <= new_account_days) & (amount >= high_value), 1.0).otherwise(0.0)


def weighted_sum(indicators: Sequence[Column], weights: Sequence[float], digits: int | None = 3) -> Column:
    terms = [F.lit(float(w)) * c for c, w in zip(indicators, weights, strict=True)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return round_exact(total, digits)


def demand_at(price: Column, reference_price: Column, reference_quantity: Column, elasticity: Column) -> Column:
    """Constant-elasticity demand."""
    return reference_quantity * F.pow(price / reference_price, -elasticity)


def markup_price(marginal_cost: Column, elasticity: Column) -> Column:
    """Profit-maximising price; null where demand is not elastic, because no maximum exists there."""
    return F.when(elasticity > 1, marginal_cost * elasticity / (elasticity - 1))


def price_label(change_pct: Column, raise_at: float = fixed.RAISE_PCT, lower_at: float = fixed.LOWER_PCT) -> Column:
    return (
        F.when(change_pct >= raise_at, "raise")
        .when(change_pct <= lower_at, "lower")
        .when(change_pct.isNotNull(), "near-optimal")
    )


def keyword_share(bm25_normalized: Column, semantic_normalized: Column, alpha: float) -> Column:
    """Share of the fused score that the keyword side contributes."""
    keyword = F.lit(float(alpha)) * bm25_normalized
    total = keyword + F.lit(1.0 - alpha) * semantic_normalized
    return keyword / F.when(total == 0, 1.0).otherwise(total)


def polarity_class(sentiment: Column, limit: float = 0.3) -> Column:
    return F.when(sentiment > limit, "positive").when(sentiment < -limit, "negative").otherwise("neutral")
