import json

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import embed, photos
from shelfwise.sources import tables
from shelfwise.sources.tables import attribution_entries

SCHEMA = (
    "noun string, position int, title string, description string, license string, license_url string, "
    "source_url string, url string, artist string"
)


def candidate(title="File:Desk lamp office led.jpg", description="", license="CC0", noun="Desk Lamp", position=0):
    return (noun, position, title, description, license, "", "http://x", "http://x", "<a href='u'>Ann</a> B")


def checks(spark, row, **arguments):
    return photos.with_checks(spark.createDataFrame([row], SCHEMA), **arguments).first().asDict()


def test_a_good_candidate_passes(spark):
    assert checks(spark, candidate())["accepted"]


@pytest.mark.parametrize(
    "failing, row",
    [
        ("not_rejected", candidate("File:Retro desk lamp.jpg")),
        ("extension_allowed", candidate("File:Desk lamp office led.gif")),
        ("extension_allowed", candidate("File:Desk lamp office led")),
        ("license_allowed", candidate(license="GFDL")),
        ("covers_words", candidate("File:Lamp office led.jpg")),
        ("covers_words", candidate(noun="The Set")),
        ("no_negative_keyword", candidate(description="A war museum")),
        ("no_negative_keyword", candidate(description="Made with Stable Diffusion")),
        ("not_historical", candidate(description="taken in 1957")),
        ("not_historical", candidate(description="a 19th century lamp")),
    ],
)
def test_each_check_alone(spark, failing, row):
    got = checks(spark, row)
    assert not got[failing] and not got["accepted"]


def test_keywords_match_whole_words_only(spark):
    assert checks(spark, candidate(description="hardware mapping burgundy"))["no_negative_keyword"]


# the first alternative of the year pattern reaches to 1999
@pytest.mark.parametrize("year, ok", [(1599, True), (1600, False), (1990, False), (1999, False), (2000, True)])
def test_years(spark, year, ok):
    assert checks(spark, candidate(description=f"from {year}."))["not_historical"] is ok


def test_override_replaces_the_noun(spark):
    row = candidate("File:Kite toy in the sky.png", noun="Kite")
    assert checks(spark, row)["covers_words"]
    assert not checks(spark, candidate("File:Kite.png", noun="Kite"))["covers_words"]
    assert checks(spark, candidate("File:Kite.png", noun="Kite"), overrides={})["covers_words"]


def test_license_is_trimmed_and_lowered(spark):
    assert checks(spark, candidate(license=" CC-BY-SA-4.0\n"))["license_allowed"]


def test_first_accepted_candidate_wins(spark):
    rows = [candidate(position=2), candidate(position=1), candidate(position=0, license="GFDL")]
    best = photos.best_candidates(photos.with_checks(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["noun"], r["position"]) for r in best] == [("Desk Lamp", 1)]


@pytest.mark.parametrize(
    "title, suffix, published",
    [("File:A.JPEG", ".jpeg", "jpg"), ("File:a.b.png", ".png", "png"), ("File:none", "", "jpg"), ("dot.", "", "jpg"),
     (".hidden", "", "jpg")],
)
def test_extensions(spark, title, suffix, published):
    row = spark.range(1).select(photos.extension_of(F.lit(title)).alias("a"), photos.photo_extension(F.lit(title)).alias("b"))
    assert tuple(row.first()) == (suffix, published)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("P1", "Office", "Slim Desk Lamp"), ("P2", "Office", "Big Desk Lamp"), ("P3", "Toys", "Desk Lamp"),
            ("P4", "Office", "desk lamp"), ("P5", "Office", "Stapler")]
    return spark.createDataFrame(rows, "id string, category string, title string")


@pytest.fixture(scope="module")
def nouns(spark):
    rows = [("Desk Lamp", "Office"), ("Stapler", "Office"), ("Absent", "Office")]
    return spark.createDataFrame(rows, "noun string, category string")


def test_attribution_and_counts(spark, catalog, nouns):
    best = photos.best_candidates(photos.with_checks(spark.createDataFrame([candidate()], SCHEMA)))
    credited = photos.attribute_photos(nouns, catalog, best)
    rows = {r["product_id"]: r for r in credited.collect()}
    assert set(rows) == {"P1", "P2"}
    matched = photos.match_photos(nouns, spark.createDataFrame([candidate()], SCHEMA), catalog)
    assert sorted(matched.collect()) == sorted(credited.collect())
    assert rows["P1"]["artist"] == "Ann B" and rows["P1"]["extension"] == "jpg"
    assert tuple(photos.match_counts(nouns, catalog, best).first()) == (1, 1)
    (entry,) = photos.nouns_with_products(credited).collect()
    assert entry["product_ids"] == ["P1", "P2"]
    split = photos.nouns_with_products(credited, max_ids=1).withColumn("position", F.lit(0))
    assert {r["product_id"] for r in photos.invert_attribution(split).collect()} == {"P1", "P2"}


def test_later_entry_overwrites_an_earlier_one(spark):
    def entry(artist, ids):
        return {"commons_title": "t", "source_url": "s", "artist": artist, "license": "l", "license_url": "",
                "extension": "jpg", "product_ids": ids}

    text = json.dumps({"Kite": entry("first", ["P1", "P2"]), "Lamp": entry("second", ["P2"])})
    inverted = photos.invert_attribution(attribution_entries(spark.createDataFrame([(text,)], "value string")))
    assert {r["product_id"]: r["artist"] for r in inverted.collect()} == {"P1": "first", "P2": "second"}


def test_pages_of_the_photo_search(spark):
    page = {
        "title": "File:X.jpg",
        "imageinfo": [{"url": "u", "thumburl": "t", "descriptionurl": "d",
                       "extmetadata": {"LicenseShortName": {"value": "CC0"}, "Artist": {"value": "<b>A</b>"}}}],
    }
    rows = [("n", 0, json.dumps(page)), ("n", 1, json.dumps({"title": "File:Y.jpg"}))]
    first, second = photos.parse_pages(spark.createDataFrame(rows, "noun string, position int, page string")).orderBy("position").collect()
    assert (first["url"], first["source_url"], first["license"], first["license_url"]) == ("t", "d", "CC0", "")
    assert (second["title"], second["license"], second["description"], second["url"]) == ("File:Y.jpg", "unknown", "", None)


def test_pending_images(spark):
    products = spark.createDataFrame([("P1", "Kite", "Toys", "Wood"), ("P2", "Kite", "Toys", "Wood")],
                                     "id string, title string, category string, material string")
    done = spark.createDataFrame([("P1",)], "id string")
    assert [r["id"] for r in embed.pending_images(products, done).collect()] == ["P2"]
    assert embed.pending_images(products).count() == 2


def test_published_entries_are_read_back(spark, tmp_path):
    fields = "noun string, commons_title string, source_url string, artist string, license string, license_url string, extension string, product_ids array<long>"
    rows = [("b", "t", "s", "a", "CC0", "", "jpg", [5, 7]), ("a", "u", "s", "a\"q", "pd", "x", "png", [1]), ("b", "t", "s", "a", "CC0", "", "jpg", [2, 3])]
    path = str(tmp_path / "attribution")
    tables.write_attribution(spark.createDataFrame(rows, fields), path)
    read = [(r["position"], r["noun"], r["artist"], r["product_ids"]) for r in tables.read_attribution(spark, path).collect()]
    assert sorted(read) == [(0, "a", "a\"q", ["1"]), (0, "b", "a", ["5", "7"]), (1, "b", "a", ["2", "3"])]
