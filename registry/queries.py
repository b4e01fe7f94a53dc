"""One runnable query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import views
from shelfwise import fixed_values as fixed
from shelfwise.functions import text
from shelfwise.operators import bm25, browse, cart, cells, containment, embed, evaluate, facet_index, photos, quantized, ranking, trend, triggers, vectors
from shelfwise.operators.segments import SegmentIndex
from shelfwise.plans import fraud, inventory, pricing, reviews, search
from shelfwise.sources import tables
from shelfwise.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEARCH_PHRASE = "the best of rewh"


def query(run: Query) -> Query:
    """Register a query; whole numbers come out as long, the type SQL counts in."""

    def registered(spark: SparkSession, sf: str) -> DataFrame:
        df = run(spark, sf)
        return df.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes])

    QUERIES[run.__name__] = registered
    return run


def r9(name: str) -> Column:
    return F.round(name, 9) + F.lit(0.0)


def r6(name: str) -> Column:
    return F.round(name, 6) + F.lit(0.0)


def r4(name: str) -> Column:
    return F.round(name, 4) + F.lit(0.0)


# --- search ------------------------------------------------------------------------------------


@query
def bm25_topk(spark, sf):
    best = bm25.search_text(views.documents(spark, sf), SEARCH_PHRASE, limit=20)
    return best.select(F.col("id").alias("doc_id"), r9("score").alias("score"))


@query
def text_measures(spark, sf):
    doc = F.col("text")
    return views.documents(spark, sf).select(
        F.col("id").alias("doc_id"),
        F.size(text.search_tokens(doc)).alias("search_tokens"),
        F.size(text.review_tokens(doc)).alias("review_tokens"),
        F.size(text.sentences(doc)).alias("sentences"),
    )


@query
def postings(spark, sf):
    indexed = bm25.index_documents(views.documents(spark, sf))
    return bm25.postings(indexed).select("term", F.col("id").alias("doc_id"), "tf", "length")


@query
def term_statistics(spark, sf):
    indexed = bm25.index_documents(views.documents(spark, sf))
    return bm25.term_statistics(indexed).select("term", "df", r9("idf").alias("idf"))


@query
def corpus_totals(spark, sf):
    totals = bm25.corpus_totals(bm25.index_documents(views.documents(spark, sf), only_terms=[]))
    return totals.select("n_docs", r9("avg_length").alias("avg_length"))


@query
def bm25_batch(spark, sf):
    index = search.build_index(views.documents(spark, sf))
    found = search.bm25_batch(index, views.search_queries(spark, sf), limit=5)
    return found.select("qid", F.col("id").alias("doc_id"), r9("score").alias("score"), "rank")


def _hybrid(spark, sf, limit, alpha=fixed.FUSION_ALPHA, products=None):
    """Query text from ``benchmark``, query vector from the embedding with the same number."""
    known = views.vectors(spark, sf)
    index = search.build_index(views.documents(spark, sf), known)
    asked = views.search_queries(spark, sf).join(known.withColumnRenamed("id", "qid"), "qid")
    return search.hybrid_search(index, asked, limit, alpha, products=products)


@query
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, fixed.DEFAULT_LIMIT).select(
        "qid",
        F.col("id").alias("doc_id"),
        "rank",
        *[
            r9(c).alias(c)
            for c in [
                "bm25_raw", "bm25_normalized", "semantic_raw_cosine", "semantic_normalized", "fused",
                "keyword_share",
            ]
        ],
    )


@query
def hybrid_keyword_only(spark, sf):
    """With the columns of the found documents, joined after the best rows are known."""
    found = _hybrid(spark, sf, 10, alpha=1.0, products=views.document_facts(spark, sf))
    return found.select("qid", F.col("id").alias("doc_id"), "rank", r9("fused").alias("fused"), "lang", "source")


@query
def hybrid_semantic_only(spark, sf):
    return _hybrid(spark, sf, 10, alpha=0.0).select("qid", F.col("id").alias("doc_id"), "rank", r9("fused").alias("fused"))


@query
def minmax_normalize(spark, sf):
    events = views.table(spark, sf, "events").select("event_id", "event_type", "value")
    scaled = vectors.min_max_normalize(events, ["event_type"], "value", "normalized")
    return scaled.select("event_id", "event_type", r9("normalized").alias("normalized"))


@query
def embed_documents(spark, sf):
    embedded = embed.embed_texts(views.documents(spark, sf))
    return embedded.select("id", F.posexplode("vector").alias("place", "weight")).where("weight <> 0").select(
        F.col("id").alias("doc_id"), "place", r6("weight").alias("weight")
    )


@query
def knn_cosine(spark, sf):
    near = vectors.similar_items(views.vectors(spark, sf), limit=fixed.NEIGHBOUR_POOL)
    return near.select("qid", F.col("id").alias("vec_id"), "rank", r9("score").alias("score"))


@query
def similar_for_ids(spark, sf):
    """Neighbours of the items that the benchmark numbers."""
    ids = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    near = vectors.similar_items(views.vectors(spark, sf), ids, limit=fixed.NEIGHBOUR_POOL)
    return near.select("qid", F.col("id").alias("vec_id"), "rank", r9("score").alias("score"))


@query
def search_manifest(spark, sf):
    """The figures of an index that was written to a path and opened again, with the search parameters."""
    path = f"{shared_folder(spark)}/index"
    search.build_index(views.documents(spark, sf), views.vectors(spark, sf), path)
    return search.index_figures(search.open_index(spark, path)).select(
        "n_docs", "dim", r9("avg_length").alias("avg_length"),
        *[F.lit(float(v)).alias(k) for k, v in {"k1": fixed.BM25_K1, "b": fixed.BM25_B, "alpha": fixed.FUSION_ALPHA}.items()],
    )


# --- ranking -----------------------------------------------------------------------------------


@query
def align_embeddings(spark, sf):
    both = vectors.align(views.products(spark, sf), views.vectors(spark, sf))
    norm = vectors.dot(F.col("vector"), F.col("vector"))
    return both.select("id", "title", r9(norm).alias("squared_norm"))


@query
def similar_products(spark, sf):
    """Neighbours among the embedded products, then only diversified."""
    products = views.products(spark, sf)
    known = vectors.align(products.select("id"), views.vectors(spark, sf))
    near = vectors.similar_items(known, limit=fixed.NEIGHBOUR_POOL).withColumnRenamed("score", "base_score")
    candidates = near.drop("rank").join(products, "id")
    ranked = ranking.rerank(candidates, fixed.NEIGHBOUR_LIMIT, fixed.RECOMMENDATION_WEIGHTS)
    return ranked.select(
        "qid", "id", "rank", r9("base_score").alias("base_score"), r9("diversity_penalty").alias("diversity_penalty"),
        r9("adjusted_score").alias("adjusted_score"),
    )


def _ranked_products(spark, sf):
    """All products of a category as the candidate pool of that category."""
    products = views.products(spark, sf)
    pool = products.withColumn("qid", F.col("category")).withColumn("base_score", F.col("price") / 2000)
    return ranking.rerank(pool, fixed.DEFAULT_LIMIT, fixed.SEARCH_WEIGHTS)


@query
def rerank_diverse(spark, sf):
    return _ranked_products(spark, sf).select(
        "qid",
        "id",
        "rank",
        *[
            r9(c).alias(c)
            for c in [
                "base_score", "rating_boost", "popularity_boost", "diversity_penalty", "final_score", "adjusted_score",
            ]
        ],
    )


@query
def search_page(spark, sf):
    """Ranked rows filtered and sorted for display; the rank stays the one of the ranking."""
    shown = browse.filter_products(_ranked_products(spark, sf), min_rating=2.9, max_price=2500.0)
    return browse.sort_products(shown, "price-asc").select("qid", "id", "rank", "price", r9("rating").alias("rating"))


@query
def catalog_search(spark, sf):
    """From a query to the page shown: the product names as queries, a pool by hybrid search, the pool
    reranked, filtered and sorted for display."""
    products = views.products(spark, sf)
    known = views.vectors(spark, sf)
    texts = products.select("id", text.search_text(F.col("title"), F.col("description")).alias("text"))
    asked = views.name_queries(spark, sf)
    pool = search.hybrid_search(
        search.build_index(texts, known), asked, fixed.CANDIDATE_POOL, fixed.FUSION_ALPHA, products=products
    )
    ranked = ranking.rerank(pool.withColumnRenamed("fused", "base_score").drop("rank"))
    shown = browse.sort_products(browse.filter_products(ranked, min_rating=2.9), "rating")
    return shown.select(
        "qid", "id", "rank", "title", r9("base_score").alias("base_score"), r9("adjusted_score").alias("adjusted_score")
    )


# --- browsing ----------------------------------------------------------------------------------


@query
def category_page(spark, sf):
    page = browse.browse(
        views.products(spark, sf), "standard", "rating", min_rating=2.5, brands=[f"Brand#{n}" for n in range(1, 16)]
    )
    return page.select("id", "title", "brand", "price", r9("rating").alias("rating"))


@query
def category_slugs(spark, sf):
    labels = views.products(spark, sf).select(F.concat_ws(" & ", "category", "brand").alias("label")).distinct()
    return labels.select("label", text.slugify(F.col("label")).alias("slug"))


@query
def faceted_filter(spark, sf):
    kept = browse.filter_products(
        views.products(spark, sf), min_rating=3.0, max_price=1000.0, materials=["ring", "bolt", "rod"]
    )
    return kept.select("id", "material", "price", r9("rating").alias("rating"))


@query
def facets(spark, sf):
    return browse.facets(views.products(spark, sf))


@query
def price_ceiling(spark, sf):
    return browse.price_ceiling(views.products(spark, sf))


@query
def top_rated(spark, sf):
    best = browse.top_rated(views.products(spark, sf))
    return best.select("id", "rating_count", r9("rating").alias("rating"))


@query
def newest(spark, sf):
    return browse.newest(views.products(spark, sf)).select("id", "title", "created_at")


@query
def product_detail(spark, sf):
    return browse.by_id(views.products(spark, sf), 7).select("id", "title", "category", "brand", "price")


# --- reviews -----------------------------------------------------------------------------------


def _analysis(spark, sf, digits: int | None = 3):
    return reviews.analyze_reviews(
        views.reviews(spark, sf),
        views.review_products(spark, sf),
        views.ASPECTS,
        views.LEXICON,
        digits=digits,
    )


@query
def sentiment(spark, sf):
    doc = F.col("text")
    return views.documents(spark, sf).select(
        F.col("id").alias("doc_id"),
        r9(text.sentiment(doc)).alias("default_score"),
        r9(text.sentiment(doc, views.LEXICON)).alias("custom_score"),
    )


@query
def aspects(spark, sf):
    opinions = text.aspect_opinions(F.col("text"), F.col("lang"), views.ASPECTS, views.LEXICON, digits=None)
    docs = views.long_texts(spark, sf)
    listed = docs.select("doc_id", F.explode_outer(opinions).alias("aspect", "score"))
    return listed.where("aspect is not null").select(
        "doc_id", "aspect", r9("score").alias("score")
    )


@query
def duplicate_text(spark, sf):
    docs = views.table(spark, sf, "documents")
    copies = reviews.text_copies(docs, "text", min_copies=2)
    return docs.select("doc_id", F.sha2("text", reviews.DIGEST_BITS).alias("digest")).join(copies, "digest").select(
        "doc_id", "copies", (F.col("copies") >= fixed.DUPLICATE_COPIES).alias("is_duplicate")
    )


@query
def author_burst(spark, sf):
    return reviews.author_bursts(views.order_reviews(spark, sf), max_days=1500)


@query
def fake_score(spark, sf):
    return _analysis(spark, sf).select(
        "review_id", "product_id", r9("sentiment_score").alias("sentiment_score"), F.size("aspects").alias("n_aspects"),
        "generic_text", "duplicate_text", "author_burst", "fake_score", "likely_fake",
    )


@query
def review_summary(spark, sf):
    return reviews.summarize_products(_analysis(spark, sf, None), digits=None).select(
        "product_id", "review_count", r9("avg_sentiment").alias("avg_sentiment"), "likely_fake_count",
        F.size("aspects").alias("n_aspects"),
    )


@query
def aspect_summary(spark, sf):
    badges = reviews.aspect_badges(reviews.summarize_products(_analysis(spark, sf, None), digits=None))
    return badges.withColumn("avg_sentiment", r9("avg_sentiment"))


@query
def review_evaluation(spark, sf):
    labelled = _analysis(spark, sf).join(views.fake_labels(spark, sf), "review_id")
    return evaluate.evaluate_flags(labelled, "likely_fake", "is_fake", digits=9)


@query
def product_reviews(spark, sf):
    listed = reviews.product_reviews(views.reviews(spark, sf), _analysis(spark, sf))
    return listed.select("id", "product_id", "helpful_votes", "sentiment_score", "fake_score", "likely_fake")


@query
def review_manifest(spark, sf):
    analysis = _analysis(spark, sf)
    counts = analysis.agg(
        F.count(F.lit(1)).alias("num_reviews"),
        F.count_if("likely_fake").alias("num_likely_fake"),
        F.countDistinct("product_id").alias("num_products"),
    )
    manifest = tables.run_manifest(counts, {"fake_score_threshold": fixed.FAKE_THRESHOLD})
    return manifest.select("num_reviews", "num_likely_fake", "num_products", "parameters")


# --- fraud -------------------------------------------------------------------------------------


@query
def velocity(spark, sf):
    return fraud.velocity(views.event_transactions(spark, sf)).select("id", "nearby", "velocity")


@query
def velocity_six_hours(spark, sf):
    return fraud.velocity(views.event_transactions(spark, sf), minutes=360).select("id", "nearby", "velocity")


def _fraud(transactions):
    return fraud.score_fraud(transactions, high_value=50_000.0)


@query
def fraud_score(spark, sf):
    return _fraud(views.transactions(spark, sf)).select(
        "id", "velocity", "region_risk", "new_account_high_value", "fraud_score", "likely_fraud"
    )


@query
def fraud_report(spark, sf):
    transactions = views.transactions(spark, sf)
    report = fraud.fraud_report(transactions, fraud.fraud_scores_table(_fraud(transactions)))
    return report.select("id", "buyer_id", "amount", "fraud_score", "likely_fraud")


@query
def fraud_evaluation(spark, sf):
    return evaluate.evaluate_flags(_fraud(views.transactions(spark, sf)), "likely_fraud", "is_fraud", digits=9)


# --- inventory ---------------------------------------------------------------------------------


def _series(spark, sf):
    return inventory.with_seasonal_index(inventory.daily_series(views.inventory_history(spark, sf)))


def _forecasts(spark, sf, rounded: bool = True):
    return inventory.forecast_inventory(views.inventory_history(spark, sf), rounded=rounded)


@query
def seasonal_index(spark, sf):
    factors = F.posexplode_outer("seasonal_index").alias("weekday", "factor")
    return _series(spark, sf).select("product_id", factors).select("product_id", "weekday", r9("factor").alias("factor"))


@query
def holt_state(spark, sf):
    state = inventory.with_holt(_series(spark, sf))
    return state.select("product_id", r6("level").alias("level"), r6("trend").alias("trend"))


@query
def inventory_forecast(spark, sf):
    figures = ["avg_daily_forecast", "demand_std_dev", "reorder_point", "days_of_supply"]
    return _forecasts(spark, sf, rounded=False).select(
        "product_id", "current_stock", "needs_reorder", "stockout_days_observed", *[r6(c).alias(c) for c in figures]
    )


@query
def supply_report(spark, sf):
    report = inventory.supply_report(_forecasts(spark, sf, rounded=False), views.products(spark, sf))
    return report.select("product_id", "title", "current_stock", r6("days_of_supply").alias("days_of_supply"))


@query
def reorder_count(spark, sf):
    return inventory.reorder_count(_forecasts(spark, sf))


# --- pricing -----------------------------------------------------------------------------------


def _priced(spark, sf, rounded: bool = False):
    return pricing.price_products(views.pricing_inputs(spark, sf), rounded=rounded)


@query
def price_recommendation(spark, sf):
    figures = [
        "elasticity", "marginal_cost", "current_price", "current_quantity", "current_revenue", "current_profit",
        "optimal_price", "optimal_quantity", "optimal_revenue", "optimal_profit", "price_change_pct",
        "profit_uplift_pct",
    ]
    return _priced(spark, sf).select("product_id", "recommendation", *[r4(c).alias(c) for c in figures])


@query
def price_curve(spark, sf):
    points = pricing.price_curve(_priced(spark, sf))
    return points.select("product_id", *[r4(c).alias(c) for c in points.columns if c != "product_id"])


@query
def price_label_counts(spark, sf):
    return pricing.label_counts(_priced(spark, sf))


# --- photos, images ----------------------------------------------------------------------------


def _checked(spark, sf):
    extension = F.coalesce(F.nullif(F.regexp_extract("url", r"(\.[a-z]+)$", 1), F.lit("")), F.lit("none"))
    return photos.with_checks(
        views.photo_candidates(spark, sf),
        overrides=views.PHOTO_OVERRIDES,
        rejected=views.PHOTO_REJECTED,
        extensions=[".html", "none"],
        keywords=views.PHOTO_KEYWORDS,
        stopwords=["the"],
        extension=extension,
    )


@query
def photo_checks(spark, sf):
    return _checked(spark, sf).select(
        "noun", "position", "not_rejected", "extension_allowed", "license_allowed", "covers_words",
        "no_negative_keyword", "not_historical", "accepted",
    )


@query
def photo_match(spark, sf):
    return photos.best_candidates(_checked(spark, sf)).select("noun", "position", "title", "license")


@query
def photo_pages(spark, sf):
    """The nested JSON of a photo search, made from the pages, taken apart again."""
    found = photos.parse_pages(views.photo_responses(spark, sf))
    return found.select(
        "position",
        "title",
        "url",
        photos.strip_tags(F.col("artist")).alias("artist"),
        "license",
        "license_url",
        photos.extension_of(F.col("title")).alias("suffix"),
        photos.photo_extension(F.col("title")).alias("extension"),
    )


@query
def noun_products(spark, sf):
    return photos.products_of_nouns(views.nouns(spark), views.products(spark, sf))


def _noun_photos(spark, sf):
    """Photos for the product nouns: the page with the lowest number of those given to a noun."""
    pages = views.table(spark, sf, "pages")
    ids = [noun for noun, _ in views.NOUNS]
    noun = F.get(F.array(*[F.lit(n) for n in ids]), (F.col("page_id") % len(ids)).cast("int"))
    return photos.best_candidates(
        pages.select(
            noun.alias("noun"),
            F.col("page_id").alias("position"),
            F.concat("url", F.lit(".jpeg")).alias("title"),
            F.col("url").alias("source_url"),
            "url",
            F.lit("<i>someone</i>").alias("artist"),
            F.lit("CC0").alias("license"),
            F.lit("").alias("license_url"),
            F.col("page_id").isNotNull().alias("accepted"),
        )
    )


def _attributed(spark, sf):
    return photos.attribute_photos(views.nouns(spark), views.products(spark, sf), _noun_photos(spark, sf))


@query
def photo_match_counts(spark, sf):
    return photos.match_counts(views.nouns(spark), views.products(spark, sf), _noun_photos(spark, sf))


@query
def photo_attribution(spark, sf):
    return _attributed(spark, sf)


@query
def attribution_invert(spark, sf):
    """The published entries, noun by noun, turned back into one row per product."""
    entries = photos.nouns_with_products(_attributed(spark, sf))
    places = F.create_map(*[F.lit(x) for i, (noun, _) in enumerate(views.NOUNS) for x in (noun, i)])
    numbered = entries.withColumn("position", places[F.col("noun")])
    return photos.invert_attribution(numbered).select("product_id", "noun", "commons_title", "extension")


@query
def image_prompts(spark, sf):
    """Products that no photo covers yet."""
    done = _attributed(spark, sf).select(F.col("product_id").alias("id")).distinct()
    return embed.pending_images(views.products(spark, sf), done)


# --- carts -------------------------------------------------------------------------------------


@query
def cart_state(spark, sf):
    return cart.cart_state(views.cart_events(spark, sf))


@query
def cart_totals(spark, sf):
    totals = cart.cart_totals(cart.cart_state(views.cart_events(spark, sf)), views.products(spark, sf))
    return totals.select("cart_id", "item_count", r9("subtotal").alias("subtotal"))


# --- sources and sinks -------------------------------------------------------------------------


@query
def columnar_embeddings(spark, sf):
    """Embeddings written as columnar JSON records and scanned back as rows."""
    folder = shared_folder(spark)
    records = tables.columnar_embeddings(views.vectors(spark, sf), "given", max_items=100)
    tables.write_table(records, folder, fmt="json")
    rows = tables.read_embeddings(spark, folder, fmt="jsonl")
    places = rows.select(
        F.col("id").cast("long").alias("vec_id"), F.size("vector").alias("dim"), F.posexplode("vector").alias("place", "value")
    ).withColumn("value", F.col("value").cast("double"))
    return places.select("vec_id", "dim", "place", r6("value").alias("value"))


@query
def published_inputs(spark, sf):
    """Pricing inputs stored, published as JSON and scanned back with the declared schema."""
    folder = shared_folder(spark)
    tables.write_table(views.pricing_inputs(spark, sf), f"{folder}/stored")
    tables.publish(spark, {"pricing_inputs": f"{folder}/stored"}, f"{folder}/out", fmt="json")
    return tables.read_table(spark, "pricing_inputs", f"{folder}/out/pricing_inputs", fmt="jsonl").select(
        "product_id", "reference_quantity", *[r9(c).alias(c) for c in ["elasticity", "marginal_cost", "reference_price"]]
    )


# --- search over a kept index ------------------------------------------------------------------


@query
def bm25_segments(spark, sf):
    """The ranking of ``bm25_batch`` from an index with block maxima, with the postings of each query's terms."""
    index = SegmentIndex.create(spark, shared_folder(spark), views.documents(spark, sf))
    found, work = index.search(views.search_queries(spark, sf), limit=5)
    ranked = found.join(work, "qid", "left")
    return ranked.select("qid", F.col("id").alias("doc_id"), r9("score").alias("score"), "rank", F.coalesce("postings", F.lit(0)).alias("postings"))


@query
def segment_work(spark, sf):
    """How much of a query's postings the search read: one of few words, and whole texts."""
    index = SegmentIndex.create(spark, shared_folder(spark), views.documents(spark, sf))
    words = spark.createDataFrame([(-1, SEARCH_PHRASE)], "qid long, text string")
    work = index.search(views.search_queries(spark, sf).unionByName(words), limit=5)[1]
    return work.select("qid", "postings", "scored", (1 - F.col("scored") / F.col("postings")).alias("skipped"))


def _changed_index(spark, sf):
    """An index of all documents, then without those of low quality, then with the benchmark's texts beside them."""
    index = SegmentIndex.create(spark, shared_folder(spark), views.documents(spark, sf))
    labels = views.table(spark, sf, "labels")
    index.delete(labels.filter("quality = 0").select(F.col("doc_id").alias("id")))
    index.insert(views.search_queries(spark, sf).select((F.lit(views.BENCHMARK_IDS) + F.col("qid")).alias("id"), "text"))
    return index


@query
def changed_term_statistics(spark, sf):
    """Frequencies after inserts and deletes, from the signed changes alone."""
    return _changed_index(spark, sf).term_statistics().select("term", "df", r9("idf").alias("idf"))


@query
def changed_search(spark, sf):
    found, _ = _changed_index(spark, sf).search(views.search_queries(spark, sf), limit=5)
    return found.select("qid", F.col("id").alias("doc_id"), r9("score").alias("score"), "rank")


@query
def merged_search(spark, sf):
    """The same after all segments were merged into one."""
    index = _changed_index(spark, sf)
    index.merge()
    found, _ = index.search(views.search_queries(spark, sf), limit=5)
    return found.select("qid", F.col("id").alias("doc_id"), r9("score").alias("score"), "rank")


# --- neighbours with pruning -------------------------------------------------------------------


@query
def knn_cells(spark, sf):
    """The neighbours of ``knn_cosine`` by cells and bounds."""
    near = cells.similar_items(views.vectors(spark, sf), limit=fixed.NEIGHBOUR_POOL)
    return near.select("qid", F.col("id").alias("vec_id"), "rank", r9("score").alias("score"))


@query
def neighbour_work(spark, sf):
    """Scores that the pruned search computed for each item, of those that all pairs would take."""
    known = views.vectors(spark, sf)
    work = cells.nearest(cells.build_cells(known), known.withColumnRenamed("id", "qid"), fixed.NEIGHBOUR_POOL)[1]
    return work.withColumn("all_pairs", F.lit(known.where("vector is not null").count()))


def _quantized(spark, sf):
    """About the best neighbours of every item whose id is divisible by 50, from an index of all items."""
    known = views.vectors(spark, sf)
    quantizer = quantized.fit(known)
    index = quantized.build(known, quantizer)
    probes = quantized.calibrate(known, index, quantizer, fixed.NEIGHBOUR_POOL)
    asked = known.withColumnRenamed("id", "qid").filter("qid % 50 = 0")
    return quantized.search(known, index, quantizer, asked, probes, fixed.NEIGHBOUR_POOL), vectors.nearest(known, asked, fixed.NEIGHBOUR_POOL)


@query
def quantized_neighbours(spark, sf):
    found, _ = _quantized(spark, sf)
    return found.select("qid", F.col("id").alias("vec_id"), "rank", r9("score").alias("score"))


@query
def quantized_recall(spark, sf):
    """The index against all rows: whether nine of ten true neighbours were found."""
    found, exact = _quantized(spark, sf)
    return quantized.recall(found, exact).select("n_queries", "neighbours", (F.col("recall") >= 0.9).alias("reached"))


# --- places in a whole order -------------------------------------------------------------------


@query
def category_positions(spark, sf):
    """The products of a category page with their place under each sort."""
    kept = browse.filter_products(browse.in_category(views.products(spark, sf), "standard"), min_rating=2.5).select("id", "price", "rating")
    modes = [browse.positions(kept, mode).withColumn("sort", F.lit(mode)) for mode in ("rating", "price-asc", "price-desc")]
    return reduce(DataFrame.unionByName, modes).select("sort", "position", "id", "price", r9("rating").alias("rating"))


@query
def search_positions(spark, sf):
    """Ranked rows filtered for display, with their place under each sort and the rank they had."""
    shown = browse.filter_products(_ranked_products(spark, sf), min_rating=2.9, max_price=2500.0).select("qid", "id", "rank", "price", "rating")
    modes = [browse.positions(shown, mode, "qid").withColumn("sort", F.lit(mode)) for mode in browse.SORTS]
    return reduce(DataFrame.unionByName, modes).select("sort", "position", "qid", "id", "rank")


@query
def review_positions(spark, sf):
    """All reviews in the order of their products' pages."""
    found = reviews.review_positions(views.reviews(spark, sf))
    return found.select("position", "id", "product_id", "helpful_votes")


# --- large tables of triggers, long series -----------------------------------------------------


@query
def trigger_mentions(spark, sf):
    """Sentences of each document that mention an aspect, by a trigger for every longer word of the benchmark."""
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("body"))
    found = triggers.mentions(docs, views.trigger_table(spark, sf))
    return found.groupBy(F.col("id").alias("doc_id"), "aspect").agg(F.count(F.lit(1)).alias("mentions"))


@query
def holt_scan(spark, sf):
    """Level and trend of ``holt_state``, from composed days."""
    state = trend.holt_scan(trend.daily_demand(views.inventory_history(spark, sf)))
    return state.select("product_id", r6("level").alias("level"), r6("trend").alias("trend"))


@query
def facet_selections(spark, sf):
    """The facets of the current list for every single selection of a brand or a material."""
    index = facet_index.build_facet_index(views.products(spark, sf))
    chosen = index.bitmaps.select(F.concat_ws("=", "facet", "value").alias("selection"), "facet", "value").distinct()
    return facet_index.facets_of(index, chosen)


@query
def name_containment(spark, sf):
    """Products whose title contains a name, or a word of a name, that some product of the category has."""
    products = views.products(spark, sf)
    phrases = F.array_union(F.array("title"), F.split("title", " "))
    names = products.select(F.explode(phrases).alias("noun"), "category").distinct()
    return containment.products_of_nouns(names, products)


# --- optional files, blank queries, sorted exports ---------------------------------------------


@query
def kept_manifest(spark, sf):
    """A manifest written and read back, and one that was never written."""
    folder = shared_folder(spark)
    counts = views.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("num_documents"), F.count_distinct("lang").alias("num_languages"))
    tables.write_table(tables.run_manifest(counts, {"limit": fixed.DEFAULT_LIMIT}), f"{folder}/manifest", "json")
    absent = tables.read_manifest(spark, f"{folder}/other_manifest") is None
    found = tables.read_manifest(spark, f"{folder}/manifest")
    return found.select("num_documents", "num_languages", "parameters", F.lit(absent).alias("other_is_absent"))


@query
def blank_queries(spark, sf):
    """``hybrid_search`` where every second query text was replaced by white space: those give no rows."""
    known = views.vectors(spark, sf)
    index = search.build_index(views.documents(spark, sf), known)
    asked = views.search_queries(spark, sf).join(known.withColumnRenamed("id", "qid"), "qid")
    asked = asked.withColumn("text", F.when(F.col("qid") % 2 == 1, F.lit(" \n\t")).otherwise(F.col("text")))
    found = search.hybrid_search(index, asked, fixed.DEFAULT_LIMIT)
    return found.select("qid", F.col("id").alias("doc_id"), "rank", r9("fused").alias("fused"))


@query
def sorted_export(spark, sf):
    """Forecasts exported by product and read back, with the place of each row in the files."""
    path = f"{shared_folder(spark)}/forecasts"
    tables.write_table(_forecasts(spark, sf).select("product_id", "current_stock"), path, order_by="product_id")
    return tables.file_positions(spark, path)


@query
def photo_pipeline(spark, sf):
    """The whole photo chain: answers of a search, checks, choice, products, the published file, and a credit for each product."""
    entries = photos.photo_entries(
        views.nouns(spark),
        views.chain_responses(spark, sf),
        views.products(spark, sf),
        overrides=views.CHAIN_PHRASES,
        rejected=[f"File:{t}.png" for t in views.PHOTO_REJECTED],
        keywords=views.PHOTO_KEYWORDS,
    )
    path = f"{shared_folder(spark)}/attribution"
    tables.write_attribution(entries, path)
    # in a file entries follow their nouns, and the last one that names a product counts
    read = tables.read_attribution(spark, path).withColumn("position", F.col("noun"))
    return photos.invert_attribution(read).select("product_id", "noun", "commons_title", "source_url", "artist", "license", "extension")
