"""Price recommendations under constant-elasticity demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.rounding import round_exact
from shelfwise.functions.scores import demand_at, markup_price, price_label
from shelfwise.functions.text import bind


def price_products(
    inputs: DataFrame,
    multipliers: Sequence[float] = tuple(fixed.CURVE_MULTIPLIERS),
    raise_at: float = fixed.RAISE_PCT,
    lower_at: float = fixed.LOWER_PCT,
    rounded: bool = True,
) -> DataFrame:
    """``inputs(product_id, elasticity, marginal_cost, reference_price, reference_quantity)`` to current and
    optimal figures, a label and a response curve. One projection, no shuffle.

    The optimal price is a price, so it is rounded to cents before anything follows from it; the label
    likewise follows from the change rounded to one decimal. ``rounded=False`` leaves the other figures as
    they are.
    """
    p0, q0 = F.col("reference_price"), F.col("reference_quantity")
    cost, e = F.col("marginal_cost"), F.col("elasticity")
    money, tenth = (2, 1) if rounded else (None, None)

    def point(m):
        return bind(
            round_exact(p0 * m, 2),
            lambda price: bind(
                demand_at(price, p0, q0, e),
                lambda quantity: F.struct(
                    m.alias("price_multiplier"),
                    price.alias("price"),
                    round_exact(quantity, tenth).alias("quantity"),
                    round_exact(price * quantity, money).alias("revenue"),
                    round_exact((price - cost) * quantity, money).alias("profit"),
                ),
            ),
        )

    best_price, best_quantity = F.col("optimal_price"), F.col("_quantity")
    now, then = F.col("_profit"), F.col("_best_profit")
    return (
        inputs.withColumn("optimal_price", round_exact(markup_price(cost, e), 2))
        .withColumn("_quantity", demand_at(best_price, p0, q0, e))
        .withColumn("_profit", (p0 - cost) * q0)
        .withColumn("_best_profit", (best_price - cost) * best_quantity)
        .withColumn("price_change_pct", round_exact((best_price - p0) / p0 * 100, 1))
        .select(
            "product_id",
            "elasticity",
            "marginal_cost",
            p0.alias("current_price"),
            round_exact(q0.cast("double"), tenth).alias("current_quantity"),
            round_exact(p0 * q0, money).alias("current_revenue"),
            round_exact(now, money).alias("current_profit"),
            "optimal_price",
            round_exact(best_quantity, tenth).alias("optimal_quantity"),
            round_exact(best_price * best_quantity, money).alias("optimal_revenue"),
            round_exact(then, money).alias("optimal_profit"),
            "price_change_pct",
            F.when(now == 0, 0.0)
            .otherwise(round_exact(F.try_divide(then - now, now) * 100, tenth))
            .alias("profit_uplift_pct"),
            price_label(F.col("price_change_pct"), raise_at, lower_at).alias("recommendation"),
            F.transform(F.array(*[F.lit(float(m)) for m in multipliers]), point).alias("curve"),
        )
    )


def price_curve(priced: DataFrame) -> DataFrame:
    """The response curve as one row per product and price point."""
    return priced.select("product_id", F.inline_outer("curve"))


def label_counts(priced: DataFrame, labels: Sequence[str] = tuple(fixed.PRICE_LABELS)) -> DataFrame:
    """One row per label, also for labels that no product got."""
    counts = priced.agg(*[F.count_if(F.col("recommendation") == name).alias(name) for name in labels])
    return counts.unpivot([], list(labels), "recommendation", "products")
