"""Matching stock-photo candidates to product nouns, with attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.text import ascii_words, significant_words
from shelfwise.sources.shared import broadcast_if_small

PAGE_SCHEMA = (
    "title string, imageinfo array<struct<url string, thumburl string, descriptionurl string, "
    "extmetadata map<string, struct<value string>>>>"
)


def parse_pages(responses: DataFrame) -> DataFrame:
    """``responses(noun, position, page)``, one JSON page of a photo search each, to candidate rows."""
    page = F.from_json("page", PAGE_SCHEMA)
    info = F.get(F.col("page.imageinfo"), F.lit(0))
    return (
        responses.withColumn("page", page)
        .withColumn("info", info)
        .select(
            "noun",
            "position",
            F.col("page.title").alias("title"),
            F.coalesce(F.col("info.thumburl"), F.col("info.url")).alias("url"),
            F.col("info.descriptionurl").alias("source_url"),
            *[
                F.coalesce(F.try_element_at(F.col("info.extmetadata"), F.lit(key))["value"], F.lit(default)).alias(
                    name
                )
                for key, name, default in [
                    ("ImageDescription", "description", ""),
                    ("LicenseShortName", "license", "unknown"),
                    ("LicenseUrl", "license_url", ""),
                    ("Artist", "artist", "unknown"),
                ]
            ],
        )
    )


def extension_of(title: Column) -> Column:
    """Lower-cased suffix with its dot, empty without one; a leading or trailing dot makes no suffix."""
    return F.lower(F.regexp_extract(title, r"(?s)(?:^|/)[^/]+(\.[^./]+)$", 1))


def photo_extension(title: Column) -> Column:
    """Extension for the published file name: no dot, one spelling of jpg, jpg when there is none."""
    found = F.ltrim(F.regexp_replace(extension_of(title), r"^\.jpeg$", ".jpg"), F.lit("."))
    return F.when(found == "", "jpg").otherwise(found)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def has_keyword(title: Column, description: Column, keywords: Sequence[str]) -> Column:
    """Plain words must match a whole word; entries with a space or another sign match anywhere."""
    text = F.lower(F.concat_ws(" ", title, description))
    words = [k for k in keywords if k.isalnum()]
    phrases = [k for k in keywords if not k.isalnum()]
    found = F.lit(False)
    if words:
        tokens = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
        found = F.exists(tokens, lambda t: t.isin(words))
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def looks_historical(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    found = F.lit(False)
    for pattern in fixed.HISTORICAL_PATTERNS:
        found = found | text.rlike("(?U)" + pattern)
    return found


def with_checks(
    candidates: DataFrame,
    overrides: Mapping[str, str] = fixed.QUERY_OVERRIDES,
    rejected: Sequence[str] = tuple(fixed.REJECTED_TITLES),
    extensions: Sequence[str] = tuple(fixed.PHOTO_EXTENSIONS),
    licenses: Sequence[str] = tuple(fixed.PHOTO_LICENSES),
    keywords: Sequence[str] = tuple(fixed.NEGATIVE_KEYWORDS),
    stopwords: Sequence[str] = tuple(fixed.PHOTO_STOPWORDS),
    extension: Column | None = None,
) -> DataFrame:
    """Candidates with one flag per check and ``accepted``. ``extension`` replaces the title's suffix."""
    noun, title = F.col("noun"), F.col("title")
    description = F.coalesce("description", F.lit(""))
    phrase = noun
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        phrase = F.coalesce(F.try_element_at(table, noun), noun)
    wanted = significant_words(F.col("search_phrase"), list(stopwords))
    checks = {
        "not_rejected": ~title.isin(list(rejected)) if rejected else F.lit(True),
        "extension_allowed": (extension_of(title) if extension is None else extension).isin(list(extensions)),
        "license_allowed": F.lower(F.btrim("license", F.lit(fixed.WHITESPACE))).isin(list(licenses)),
        "covers_words": (F.size(wanted) > 0) & (F.size(F.array_except(wanted, ascii_words(title))) == 0),
        "no_negative_keyword": ~has_keyword(title, description, keywords),
        "not_historical": ~looks_historical(title, description),
    }
    checked = candidates.withColumn("search_phrase", phrase).withColumns(checks)
    accepted = F.lit(True)
    for name in checks:
        accepted = accepted & F.col(name)
    return checked.withColumn("accepted", accepted)


def best_candidates(checked: DataFrame) -> DataFrame:
    """The accepted candidate with the lowest position per noun, by a partial aggregate, not a sort."""
    photo = F.struct("position", "title", "source_url", "url", "artist", "license", "license_url")
    return (
        checked.where("accepted")
        .groupBy("noun")
        .agg(F.min_by(photo, "position").alias("photo"))
        .select("noun", "photo.*")
    )


def products_of_nouns(nouns: DataFrame, products: DataFrame) -> DataFrame:
    """``nouns(noun, category)`` matched with the products of the category whose title contains the noun."""
    named = products.select("id", "category", "title")
    # few categories: next to a small list of nouns the products stay where they are
    nouns = broadcast_if_small(nouns.select("noun", "category"))
    return named.join(
        nouns,
        (named["category"] == nouns["category"]) & F.contains(named["title"], nouns["noun"]),
    ).select("noun", "id")


def attribute_photos(nouns: DataFrame, products: DataFrame, best: DataFrame) -> DataFrame:
    """One row per product with a photo: the noun, the photo and what has to be credited."""
    return products_of_nouns(nouns, products).join(best, "noun").select(
        F.col("id").alias("product_id"),
        "noun",
        F.col("title").alias("commons_title"),
        "source_url",
        strip_tags(F.col("artist")).alias("artist"),
        "license",
        "license_url",
        photo_extension(F.col("title")).alias("extension"),
    )


def match_photos(nouns: DataFrame, candidates: DataFrame, products: DataFrame, **checks) -> DataFrame:
    """Check the candidates, take the first good one per noun and credit it on the noun's products."""
    return attribute_photos(nouns, products, best_candidates(with_checks(candidates, **checks)))


def photo_entries(nouns: DataFrame, responses: DataFrame, products: DataFrame, **checks) -> DataFrame:
    """From the answers of a photo search to the entries to publish: parse, check, choose, credit, and list the products."""
    return nouns_with_products(match_photos(nouns, parse_pages(responses), products, **checks))


def match_counts(nouns: DataFrame, products: DataFrame, best: DataFrame) -> DataFrame:
    """Nouns that have products: how many found a photo and how many did not."""
    present = products_of_nouns(nouns, products).select("noun").distinct()
    return present.join(best.select("noun", F.lit(True).alias("hit")), "noun", "left").agg(
        F.count_if(F.col("hit")).alias("matched"), F.count_if(F.col("hit").isNull()).alias("skipped")
    )


def nouns_with_products(attributed: DataFrame, max_ids: int = 10_000) -> DataFrame:
    """The published shape: a noun with the ids of the products that share its photo.

    A noun with more than about ``max_ids`` products is written as several entries, so no entry grows with
    the catalog; reading them back gives the same rows.
    """
    # the join key differs from the grouping key, so a hot noun is not kept together after the join
    key = F.struct("noun").alias("key")
    sizes = attributed.groupBy("noun").agg(F.count(F.lit(1)).alias("n")).select(key, "n")
    return (
        attributed.withColumn("key", F.struct("noun"))
        .join(sizes, "key")
        .withColumn("part", F.pmod(F.xxhash64("product_id"), F.ceil(F.col("n") / max_ids)))
        .groupBy("noun", "part", "commons_title", "source_url", "artist", "license", "license_url", "extension")
        .agg(F.sort_array(F.collect_list("product_id")).alias("product_ids"))
        .drop("part")
    )


def invert_attribution(entries: DataFrame) -> DataFrame:
    """``entries(position, noun, ..., product_ids)`` to one row per product; the last entry wins."""
    credit = ["noun", "commons_title", "source_url", "artist", "license", "license_url", "extension"]
    return (
        entries.select("position", *credit, F.explode("product_ids").alias("product_id"))
        .groupBy("product_id")
        .agg(F.max_by(F.struct(*credit), "position").alias("credit"))
        .select("product_id", "credit.*")
    )
