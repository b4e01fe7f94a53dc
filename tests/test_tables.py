import json
import time
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.plans.pricing import price_products
from shelfwise.sources import shared, tables
from shelfwise.sources.schemas import SCHEMAS

INPUTS = [{"product_id": "P1", "elasticity": 2.0, "marginal_cost": 5.0, "reference_price": 9.0, "reference_quantity": 7}]


def dump(path, value):
    path.write_text(json.dumps(value, indent=2), encoding="utf-8")
    return str(path)


def test_json_array_with_fixed_schema(spark, tmp_path):
    path = dump(tmp_path / "transactions.json", [
        {"id": "T1", "product_id": "P1", "buyer_id": "B", "quantity": 1, "amount": 9.5, "payment_method": "card",
         "shipping_region": "US", "billing_region": "EU", "buyer_account_age_days": 3,
         "created_at": "2026-01-02T03:04", "is_fraud_synthetic": True},
    ])
    frame = tables.read_table(spark, "transactions", path)
    assert frame.schema == StructType.fromDDL(SCHEMAS["transactions"])
    assert frame.first()["created_at"] == datetime(2026, 1, 2, 3, 4)


def test_lines_and_parquet(spark, tmp_path):
    inputs = spark.createDataFrame([tuple(r.values()) for r in INPUTS], SCHEMAS["pricing_inputs"])
    for fmt, written in [("jsonl", "json"), ("parquet", "parquet")]:
        path = str(tmp_path / fmt)
        tables.write_table(inputs, path, written, order_by="product_id")
        assert tables.read_table(spark, "pricing_inputs", path, fmt).collect() == inputs.collect()


def test_job_from_file_to_file(spark, tmp_path):
    inputs = tables.read_table(spark, "pricing_inputs", dump(tmp_path / "in.json", INPUTS))
    tables.write_table(price_products(inputs), str(tmp_path / "out"))
    written = tables.read_table(spark, "pricing_recommendations", str(tmp_path / "out"), "parquet")
    assert written.schema == StructType.fromDDL(SCHEMAS["pricing_recommendations"])
    assert written.first()["optimal_price"] == 10.0


def test_columnar_embeddings(spark, tmp_path):
    path = dump(tmp_path / "e.json", {"model": "m", "dim": 2, "ids": ["b", "a"], "vectors": [[1.0, 0.0], [0.0, 1.0]]})
    assert [tuple(r) for r in tables.read_embeddings(spark, path).collect()] == [("b", [1.0, 0.0]), ("a", [0.0, 1.0])]


def test_attribution_file(spark, tmp_path):
    entry = {"commons_title": "t", "source_url": "s", "artist": "a", "license": "CC0", "license_url": "",
             "extension": "jpg", "product_ids": ["P1", "P2"]}
    rows = tables.read_attribution(spark, dump(tmp_path / "a.json", {"Kite": entry, "Lamp": entry})).collect()
    assert [(r["position"], r["noun"], r["product_ids"]) for r in rows] == [
        (0, "Kite", ["P1", "P2"]), (1, "Lamp", ["P1", "P2"]),
    ]


def test_optional_manifest(spark, tmp_path):
    assert tables.read_manifest(spark, str(tmp_path / "none.json")) is None
    assert tables.read_manifest(spark, dump(tmp_path / "m.json", {"dim": 384})).first()["dim"] == 384


def test_run_manifest(spark):
    counts = spark.range(5).agg(F.count(F.lit(1)).alias("num_products"))
    row = tables.run_manifest(counts, {"alpha": 0.3, "beta": 0.1}, datetime.now(timezone.utc)).first()
    assert row["num_products"] == 5 and json.loads(row["parameters"]) == {"alpha": 0.3, "beta": 0.1}
    assert row["build_duration_seconds"] >= 0 and row["generated_at"].startswith(str(date.today().year))


def test_publish(spark, tmp_path):
    stored, out = str(tmp_path / "stored"), str(tmp_path / "out")
    spark.range(3).write.parquet(stored)
    written = tables.publish(spark, {"a": stored, "b": str(tmp_path / "no")}, out, optional=["b"])
    assert written == ["a"] and spark.read.parquet(f"{out}/a").count() == 3
    with pytest.raises(FileNotFoundError):
        tables.publish(spark, {"c": stored, "b": str(tmp_path / "no")}, out)
    assert not (tmp_path / "out" / "c").exists()


def test_broadcast_depends_on_the_measured_size(spark):
    frame = spark.createDataFrame([("P1", "Books"), ("P2", None)], "id string, category string")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(shared.broadcast_if_small(frame, max_bytes=64 * 2 + 2 + 5 + 2))
    assert not hinted(shared.broadcast_if_small(frame, max_bytes=64 * 2 + 2 + 5 + 1))
    assert shared.broadcast_if_small(frame.limit(0)).count() == 0


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_folder(spark).startswith(f"{root}/")
    assert shared.write_shared(spark.range(4), "n").count() == 4


def test_manifests_are_published_as_json(spark, tmp_path):
    counts = spark.createDataFrame([(3,)], "rows int")
    tables.write_table(tables.run_manifest(counts, {"k": 1}), str(tmp_path / "manifest"), "json")
    tables.write_table(counts, str(tmp_path / "counts"))
    sources = {"manifest": str(tmp_path / "manifest"), "counts": str(tmp_path / "counts"), "gone": str(tmp_path / "gone")}
    written = tables.publish(spark, sources, str(tmp_path / "out"), optional=["gone"], formats={"manifest": "json"})
    assert sorted(written) == ["counts", "manifest"]
    assert tables.read_manifest(spark, str(tmp_path / "out" / "manifest")).first()["rows"] == 3
    assert spark.read.parquet(str(tmp_path / "out" / "counts")).first()["rows"] == 3


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(1_000).select((F.col("id") % 50).alias("k"), "id")
    dealt = tables.deal(rows, "k", rows=20)
    places = dealt.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("n"), F.count("id").alias("rows"))
    assert dealt.rdd.getNumPartitions() == 50
    assert {(r["n"], r["rows"]) for r in places.collect()} == {(1, 20)}


def test_shuffle_files_go_with_the_write(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count()
    before, setting = files(), spark.conf.get(shared.SHUFFLE_CLEANUP)
    written = shared.write_shared(rows, "rows")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(shared.SHUFFLE_CLEANUP) == setting
    assert written.agg(F.sum("count")).first()[0] == 10_000
