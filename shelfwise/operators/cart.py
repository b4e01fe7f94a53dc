"""Cart contents from an ordered log of cart events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cart_state(events: DataFrame) -> DataFrame:
    """``events(cart_id, seq, action, product_id, quantity)`` to the lines ``(cart_id, product_id, quantity)``.

    ``add`` puts a product in or raises its quantity, ``set`` overwrites the quantity of a product that is in
    (0 or less takes it out), ``remove`` takes it out, ``clear`` empties the cart. ``seq`` orders the events of
    a cart.

    Replaying the log would need all events of a cart in one place. The outcome for a product depends on a
    few marks only: its last reset (a removal or a clear), its last overwrite, and the sums of what was added
    after each. These are plain aggregates, counted partly before the shuffle, so neither a cart nor a
    product has to fit in one task.
    """
    seq, quantity, action = F.col("seq"), F.col("quantity"), F.col("action")
    takes_out = (action == "remove") | ((action == "set") & (quantity <= 0))
    overwrites = (action == "set") & (quantity > 0)

    clears = events.where(action == "clear").groupBy("cart_id").agg(F.max("seq").alias("cleared"))
    on_products = events.where(action != "clear")
    marks = (
        on_products.groupBy("cart_id", "product_id")
        .agg(
            F.max(F.when(takes_out, seq)).alias("removed"),
            F.max(F.when(overwrites, seq)).alias("overwrite"),
            F.max_by(quantity, F.when(overwrites, seq)).alias("overwritten"),
        )
        .join(clears, "cart_id", "left")
        .select("cart_id", "product_id", F.greatest("removed", "cleared").alias("reset"), "overwrite", "overwritten")
    )
    after_reset = F.col("reset").isNull() | (seq > F.col("reset"))
    overwrite = F.col("overwrite")
    live_overwrite = overwrite.isNotNull() & (F.col("reset").isNull() | (overwrite > F.col("reset")))
    # Joined on the pair as one value: the sums then get a shuffle of their own, after a partial step, and
    # adaptive execution may split the join of a line with very many events.
    line = F.struct("cart_id", "product_id").alias("line")
    sums = (
        on_products.where(action == "add")
        .select(line, "cart_id", "product_id", "seq", "quantity")
        .join(marks.select(line, "reset", "overwrite", "overwritten"), "line")
        .where(after_reset)
        .groupBy("cart_id", "product_id")
        .agg(
            F.sum("quantity").alias("added"),
            F.count_if(live_overwrite & (seq < overwrite)).alias("n_before"),
            F.sum(F.when(seq > overwrite, quantity).otherwise(0)).alias("added_after"),
            F.max("overwritten").alias("overwritten"),
        )
    )
    # an overwrite only works on a product that was in the cart by then
    kept = F.when(F.col("n_before") > 0, F.col("overwritten") + F.col("added_after")).otherwise(F.col("added"))
    return sums.select("cart_id", "product_id", kept.alias("quantity"))


def cart_totals(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Item count and subtotal per cart; ``products(id, price)``."""
    priced = lines.join(products.select(F.col("id").alias("product_id"), "price"), "product_id")
    return priced.groupBy("cart_id").agg(
        F.sum("quantity").alias("item_count"),
        F.sum(F.col("quantity") * F.col("price")).alias("subtotal"),
    )
