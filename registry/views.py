"""The domain tables, derived from the given test tables. ``oracles.py`` states the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.text import Lexicon, search_tokens
from shelfwise.sources.shared import write_shared
from shelfwise.sources.tables import deal, spread

# A lexicon and aspect triggers of words that are frequent in the generated prose.
LEXICON = Lexicon(
    polarity={
        "best": 2.5, "and": 1.0, "on": -1.0, "it": 0.5, "to": -1.5, "la": 0.5,
        "que": -0.5, "der": 1.5, "un": -2.0, "was": -0.5, "die": 1.0, "et": 2.0,
    },
    intensifiers={"the": 1.5, "of": 2.0, "de": 0.5, "le": 1.3, "und": 1.8},
    negations=["no", "is", "en", "in"],
)
ASPECTS = {
    "en": {"build quality": ["ingth", "thand"], "price": ["tion", "ble "], "size": ["erha", "wh"]},
    "fr": {"build quality": ["eau", "oux"], "comfort": ["ment", "tre"], "price": ["aux "]},
    "de": {"price": ["sch"], "weight": ["ung", "lich"]},
}
NOUNS = [
    ("ring", "STANDARD"), ("widget", "SMALL"), ("red plate", "ECONOMY"), ("rod", "PROMO"),
    ("hot", "LARGE"), ("bolt", "MEDIUM"), ("small gear", "STANDARD"),
]
PHOTO_NOUNS = ["the and", "of the", "to", "ci", "is the", "de la", "that", "der", "eriner", "the"]
PHOTO_OVERRIDES = {"to": "to the", "that": "that is"}
PHOTO_KEYWORDS = ["on", "the reeant", "sch", "atst"]
PHOTO_REJECTED = ["Thaninhe thhewh."]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``documents``, whose texts take far longer to score than to read."""
    return spread(table(spark, sf, "documents"), "doc_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return long_texts(spark, sf).select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def document_facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")


def name_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each product name as a query, with the vector of the first embedded product of that name."""
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return (
        named.join(vectors(spark, sf), "id")
        .groupBy("text")
        .agg(F.min("id").alias("qid"), F.min_by("vector", "id").alias("vector"))
    )


#: Benchmark texts as documents have ids from here on.
BENCHMARK_IDS = 1_000_000_000


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def products(spark: SparkSession, sf: str) -> DataFrame:
    sold = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).alias("rating_count"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("cents"),
            F.min("l_shipdate").cast("date").alias("created_at"),
        )
    )
    words = F.split("p_name", " ")
    return table(spark, sf, "part").join(sold, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.get(words, F.lit(1)).alias("material"),
        F.col("p_retailprice").alias("price"),
        F.coalesce(
            F.greatest(F.lit(1.0), F.lit(5.0) - F.lit(0.4) * F.col("cents") / F.col("rating_count")), F.lit(1.0)
        ).alias("rating"),
        F.coalesce("rating_count", F.lit(0)).alias("rating_count"),
        "created_at",
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return long_texts(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", "lang", "source").alias("product_id"),
        F.floor(F.col("doc_id") / 5).alias("author"),
        F.col("text").alias("body"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 12).cast("int")).alias("created_at"),
        (F.col("n_chars") % 50).alias("helpful_votes"),
    )


def fake_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("review_id"), (F.col("quality") == 0).alias("is_fake")
    )


def review_products(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents")
        .select(F.concat_ws("-", "lang", "source").alias("id"), F.col("lang").alias("category"))
        .distinct()
    )


def order_reviews(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"))
    orders = table(spark, sf, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("author"), "product_id", F.col("o_orderdate").cast("date").alias("created_at")
    )


def event_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("buyer_id"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("amount"),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The transaction log as a stored table, which scoring and reports read more than once."""
    lines, orders = spread(table(spark, sf, "lineitem"), "l_orderkey"), table(spark, sf, "orders")
    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "r_name")
    buyers = (
        table(spark, sf, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("billing_region"))
        .join(first_order, "o_custkey")
    )
    senders = (
        table(spark, sf, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("shipping_region"))
    )
    log = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(buyers, "o_custkey")
        .join(senders, "l_suppkey")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("o_custkey").alias("buyer_id"),
            F.col("l_extendedprice").alias("amount"),
            "shipping_region",
            "billing_region",
            F.date_diff("o_orderdate", "first_order").alias("buyer_account_age_days"),
            F.col("o_orderdate").alias("created_at"),
            (F.col("l_returnflag") == "R").alias("is_fraud"),
        )
    )
    return write_shared(log, "transactions")


def inventory_history(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_returnflag"
    )
    # a product has few lines on a day, so there is nothing to combine before the shuffle
    daily = deal(lines, "product_id", "date").groupBy("product_id", "date").agg(
        F.sum("l_quantity").cast("long").alias("units_sold"),
        F.bool_or(F.col("l_returnflag") == "R").alias("stockout"),
    )
    return daily.withColumn("stock_level", (F.col("product_id") * 37 + F.col("units_sold")) % 200)


def pricing_inputs(spark: SparkSession, sf: str) -> DataFrame:
    sold = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum("l_quantity").alias("reference_quantity"))
    )
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return table(spark, sf, "part").join(sold, "p_partkey").select(
        key.alias("product_id"),
        (F.lit(1.15) + (key % 20) / F.lit(10.0)).alias("elasticity"),
        (price * (F.lit(0.20) + (key % 5) / F.lit(10.0))).alias("marginal_cost"),
        price.alias("reference_price"),
        F.col("reference_quantity").cast("long").alias("reference_quantity"),
    )


def cart_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "add").when(kind == "view", "set").when(kind == "error", "remove")
        .when(kind == "signup", F.when(F.col("event_id") % 4 == 0, "clear").otherwise("add"))
        .when(kind == "purchase", "clear")
    )
    product = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf, "events").select(
        F.col("user_id").alias("cart_id"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
        product.alias("product_id"),
        (F.floor("value") % 4).alias("quantity"),
    )


def photo_candidates(spark: SparkSession, sf: str) -> DataFrame:
    licenses = F.array(*[F.lit(x) for x in ["CC0", " cc-by ", "GFDL", "Public domain"]])
    nouns = F.array(*[F.lit(x) for x in PHOTO_NOUNS])
    # title and heading are taken out first, so that the page is not repeated for each noun
    pages = table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("description"),
    )
    return pages.select(
        F.explode(nouns).alias("noun"),
        F.col("page_id").alias("position"),
        "title",
        "description",
        F.get(licenses, (F.col("page_id") % 4).cast("int")).alias("license"),
        F.lit("").alias("license_url"),
        F.concat(F.lit("<b>page</b> "), "page_id").alias("artist"),
        F.col("url").alias("source_url"),
        F.col("url"),
    )


def photo_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as the JSON object a photo search returns; every third one without details."""
    page_id, url = F.col("page_id"), F.col("url")
    suffixes = F.array(*[F.lit(x) for x in [".JPEG", ".png", "", ".", ".tar.Jpg"]])
    title = F.concat(F.lit("File:"), F.regexp_replace(url, "[./]", "_"), F.get(suffixes, (page_id % 5).cast("int")))

    def entry(value):
        return F.struct(value.alias("value"))

    details = F.struct(
        entry(F.lit("CC0")).alias("LicenseShortName"),
        entry(F.concat(F.lit("<a href='x'>page</a> "), page_id)).alias("Artist"),
    )
    info = F.struct(
        url.alias("url"),
        F.when(page_id % 2 == 0, F.concat(url, F.lit("?thumb"))).alias("thumburl"),
        F.when(page_id % 3 != 0, details).alias("extmetadata"),
    )
    page = F.to_json(F.struct(title.alias("title"), F.array(info).alias("imageinfo")))
    return table(spark, sf, "pages").select(F.lit("any").alias("noun"), page_id.alias("position"), page.alias("page"))


def nouns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOUNS, "noun string, category string")


#: What is searched for the product nouns, and the suffixes that titles of found photos get.
CHAIN_PHRASES = {"ring": "the and", "widget": "of the", "red plate": "to", "rod": "that", "hot": "der", "bolt": "is it"}
CHAIN_SUFFIXES = [".JPEG", ".png", ".gif", "", ".Jpg"]
CHAIN_LICENSES = ["CC0", " cc-by ", "GFDL", "Public domain"]


def chain_responses(spark: SparkSession, sf: str) -> DataFrame:
    """For each product noun, every page as the JSON object that a photo search returns."""
    page_id, url = F.col("page_id"), F.col("url")

    def picked(values: list[str]):
        return F.get(F.array(*[F.lit(v) for v in values]), (page_id % len(values)).cast("int"))

    def entry(value):
        return F.struct(value.alias("value"))

    title = F.concat(F.lit("File:"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), picked(CHAIN_SUFFIXES))
    details = F.struct(
        entry(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("ImageDescription"),
        entry(picked(CHAIN_LICENSES)).alias("LicenseShortName"),
        entry(F.concat(F.lit("<b>page</b> "), page_id)).alias("Artist"),
    )
    info = F.struct(url.alias("url"), url.alias("descriptionurl"), details.alias("extmetadata"))
    found = table(spark, sf, "pages").select(page_id.alias("position"), F.to_json(F.struct(title.alias("title"), F.array(info).alias("imageinfo"))).alias("page"))
    return found.withColumn("noun", F.explode(F.array(*[F.lit(n) for n, _ in NOUNS])))


def trigger_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of five letters or more of ``benchmark`` as a trigger in each language, with aspects by its length."""
    words = table(spark, sf, "benchmark").select(F.explode(search_tokens("text")).alias("trigger")).filter(F.length("trigger") >= 5).distinct()
    aspect = F.concat(F.lit("length "), (F.length("trigger") % 7).cast("string"))
    return words.select(F.explode(F.array(*[F.lit(c) for c in ("en", "fr", "de", "es")])).alias("category"), aspect.alias("aspect"), "trigger")
