import random

import pytest

from shelfwise.operators.cart import cart_state, cart_totals

SCHEMA = "cart_id string, seq long, action string, product_id string, quantity int"


def state(spark, rows):
    return {(r["cart_id"], r["product_id"]): r["quantity"] for r in cart_state(spark.createDataFrame(rows, SCHEMA)).collect()}


def log(*events):
    return [("c", i, action, product, quantity) for i, (action, product, quantity) in enumerate(events)]


@pytest.mark.parametrize(
    "events, lines",
    [
        ([("add", "a", 1), ("add", "a", 2)], {"a": 3}),
        ([("set", "a", 5)], {}),
        ([("add", "a", 1), ("set", "a", 5), ("add", "a", 1)], {"a": 6}),
        ([("add", "a", 1), ("set", "a", 0)], {}),
        ([("add", "a", 1), ("remove", "a", 0), ("set", "a", 4)], {}),
        ([("add", "a", 1), ("clear", None, 0), ("set", "a", 4), ("add", "a", 2)], {"a": 2}),
        ([("add", "a", 1), ("add", "b", 1), ("clear", None, 0), ("add", "b", 7)], {"b": 7}),
        ([("set", "a", 9), ("add", "a", 2), ("remove", "b", 0)], {"a": 2}),
        ([("clear", None, 0)], {}),
    ],
)
def test_by_hand(spark, events, lines):
    assert state(spark, log(*events)) == {("c", p): q for p, q in lines.items()}


def test_equals_replaying_the_log(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for c in range(60):
        lines = {}
        for seq in range(rng.randint(1, 40)):
            action = rng.choices(["add", "set", "remove", "clear"], [5, 3, 1, 0.4])[0]
            product, quantity = rng.choice("abc"), rng.randint(0, 3)
            rows.append((f"c{c}", seq, action, product, quantity))
            if action == "add":
                lines[product] = lines.get(product, 0) + quantity
            elif action == "set" and product in lines:
                lines[product] = quantity
            if action == "remove" or (action == "set" and quantity <= 0):
                lines.pop(product, None)
            if action == "clear":
                lines = {}
        expected |= {(f"c{c}", p): q for p, q in lines.items()}
    rng.shuffle(rows)
    assert state(spark, rows) == expected


def test_totals(spark):
    lines = spark.createDataFrame([("c", "a", 2), ("c", "b", 1), ("d", "a", 1)], "cart_id string, product_id string, quantity int")
    prices = spark.createDataFrame([("a", 2.5), ("b", 10.0)], "id string, price double")
    got = {r["cart_id"]: (r["item_count"], r["subtotal"]) for r in cart_totals(lines, prices).collect()}
    assert got == {"c": (3, 15.0), "d": (1, 2.5)}
