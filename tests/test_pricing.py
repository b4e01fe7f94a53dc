import pytest

from shelfwise.plans import pricing

SCHEMA = "product_id string, elasticity double, marginal_cost double, reference_price double, reference_quantity int"


def priced(spark, elasticity, cost, price, quantity=100, **arguments):
    frame = spark.createDataFrame([("p", elasticity, cost, price, quantity)], SCHEMA)
    return pricing.price_products(frame, **arguments).first()


def test_figures_by_hand(spark):
    row = priced(spark, 2.0, 10.0, 25.0)
    assert row["optimal_price"] == 20.0
    assert row["optimal_quantity"] == round(100 * (20 / 25) ** -2.0, 1) == 156.2
    assert row["current_profit"] == 1500.0 and row["optimal_profit"] == 1562.5
    assert row["price_change_pct"] == -20.0 and row["recommendation"] == "lower"
    assert row["profit_uplift_pct"] == 4.2


@pytest.mark.parametrize(
    "cost, price, label",
    [(10.5, 20.0, "raise"), (9.5, 20.0, "lower"), (10.4, 20.0, "near-optimal"), (10.0, 20.0, "near-optimal")],
)
def test_labels_include_exactly_five_percent(spark, cost, price, label):
    assert priced(spark, 2.0, cost, price)["recommendation"] == label


def test_no_current_profit_means_no_uplift(spark):
    assert priced(spark, 2.0, 20.0, 20.0)["profit_uplift_pct"] == 0.0


def test_inelastic_demand_has_no_optimum(spark):
    row = priced(spark, 1.0, 10.0, 20.0)
    assert row["optimal_price"] is None and row["recommendation"] is None
    assert len(row["curve"]) == 7


def test_optimum_beats_the_current_price(spark):
    for elasticity in [1.2, 1.7, 2.5, 3.9]:
        for cost in [3.0, 11.0, 19.0]:
            row = priced(spark, elasticity, cost, 20.0, rounded=False)
            # the price is rounded to cents, so the optimum may be missed by a hair
            assert row["optimal_profit"] >= row["current_profit"] * (1 - 1e-6)


def test_curve(spark):
    row = priced(spark, 2.0, 10.0, 19.99)
    assert [p["price_multiplier"] for p in row["curve"]] == [0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3]
    point = row["curve"][0]
    price = round(19.99 * 0.7, 2)
    quantity = 100 * (price / 19.99) ** -2.0
    assert point["price"] == price and point["quantity"] == round(quantity, 1)
    assert point["revenue"] == round(price * quantity, 2)
    assert point["profit"] == round((price - 10.0) * quantity, 2)


def test_curve_rows_and_label_counts(spark):
    rows = [("a", 2.0, 10.0, 20.0, 5), ("b", 2.0, 30.0, 20.0, 5), ("c", 2.0, 40.0, 20.0, 5)]
    frame = pricing.price_products(spark.createDataFrame(rows, SCHEMA))
    assert pricing.price_curve(frame).count() == 21
    counts = {r["recommendation"]: r["products"] for r in pricing.label_counts(frame).collect()}
    assert counts == {"raise": 2, "lower": 0, "near-optimal": 1}


def test_pricing_needs_no_shuffle(spark):
    frame = pricing.price_products(spark.createDataFrame([("p", 2.0, 1.0, 2.0, 3)], SCHEMA))
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
