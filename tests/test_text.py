import random
import re

import pytest
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions import text
from shelfwise.functions.rounding import round_exact


def evaluate(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


def many(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("value, digits", [(2.675, 2), (1.005, 2), (0.125, 2), (-0.0001, 3), (1234567.5, 0), (5.05, 1)])
def test_round_exact_rounds_like_python(spark, value, digits):
    assert evaluate(spark, round_exact(F.lit(value), digits)) == round(value, digits)


def test_round_exact_keeps_null_and_can_be_off(spark):
    assert evaluate(spark, round_exact(F.lit(None).cast("double"), 2)) is None
    assert evaluate(spark, round_exact(F.lit(2.675), None)) == 2.675


def test_tokenizers(spark):
    doc = "USB-C, it's 4K!  don't"
    assert evaluate(spark, text.search_tokens(F.lit(doc))) == ["usb", "c", "it", "s", "4k", "don", "t"]
    assert evaluate(spark, text.review_tokens(F.lit(doc))) == ["usb", "c", "it's", "k", "don't"]


def test_sentences_drop_blank_parts(spark):
    assert evaluate(spark, text.sentences(F.lit(" Good. \n\t!? Bad  ...  "))) == ["Good", "Bad"]


def test_term_counts(spark):
    tokens = F.array(*[F.lit(w) for w in ["b", "a", "ab", "a", "b", "a"]])
    assert [tuple(r) for r in evaluate(spark, text.term_counts(tokens))] == [("a", 3), ("ab", 1), ("b", 2)]
    assert evaluate(spark, text.term_counts(F.array().cast("array<string>"))) == []


@pytest.mark.parametrize(
    "label, slug", [("Home & Kitchen", "home-and-kitchen"), ("  Sports &  Outdoors!", "sports-and-outdoors")]
)
def test_slugify(spark, label, slug):
    assert evaluate(spark, text.slugify(F.lit(label))) == slug


def test_diversity_key(spark):
    assert evaluate(spark, text.diversity_key(F.lit("Toys"), F.lit("Rugged Kite - Wood"))) == "Toys::rugged"


def test_document_texts(spark):
    assert evaluate(spark, text.embedding_text(F.lit("A"), F.lit("b"))) == "A. b"
    assert evaluate(spark, text.search_text(F.lit("A"), F.lit("b"))) == "A b"


def test_image_prompt_and_seed(spark):
    prompt = evaluate(spark, text.image_prompt(F.lit("Rugged Kite"), F.lit("Toys"), F.lit("Wood")))
    assert prompt == "product photo of rugged kite, a toys item, wood, white background, studio lighting"
    # first eight hex digits of the digest of "abc" are ba7816bf
    assert evaluate(spark, text.image_seed(F.lit("abc"))) == 0xBA7816BF


@pytest.mark.parametrize(
    "body, score",
    [
        ("", 0.0),
        ("the table", 0.0),
        ("good", 1.5),
        ("not good", -1.5),
        ("not very good", -2.25),
        ("very extremely good", 3.0),
        ("very blue good", 1.5),
        ("not a b good", -1.5),
        ("not a b c good", 1.5),
        ("don't good", 1.5),
        ("barely good bad", (0.75 - 1.5) / 2),
        ("no no good", -1.5),
        ("good very", 1.5),
    ],
)
def test_sentiment_by_hand(spark, body, score):
    assert evaluate(spark, text.sentiment(F.lit(body))) == pytest.approx(score, abs=1e-12)


def test_sentiment_equals_a_plain_loop(spark):
    lexicon = text.Lexicon()
    weights, scale, negations = lexicon.weights(), lexicon.intensifiers, set(lexicon.negations)
    rng = random.Random(3)
    words = [*list(weights)[:12], *scale, *negations, "table", "chair", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)]

    def loop(body):
        tokens = re.findall("[a-z']+", body)
        parts = []
        for i, token in enumerate(tokens):
            if token in weights:
                sign = -1 if negations & set(tokens[max(0, i - 3):i]) else 1
                parts.append(sign * weights[token] * scale.get(tokens[i - 1] if i else "", 1.0))
        return sum(parts) / len(parts) if parts else 0.0

    got = many(spark, texts, text.sentiment(F.col("text")))
    assert got == pytest.approx([loop(t) for t in texts], abs=1e-12)


def test_fixed_lexicon_size():
    assert text.Lexicon().size == 112


def aspects_of(spark, body, category):
    return evaluate(spark, text.aspect_opinions(F.lit(body), F.lit(category)))


def test_aspect_triggers_match_inside_words(spark):
    # "repair" contains "pair"
    assert aspects_of(spark, "A good repair. Bad", "Electronics") == {"connectivity": 1.5}


def test_two_triggers_count_once_per_sentence(spark):
    found = aspects_of(spark, "Good price and value! Terrible cost.", "Electronics")
    # "good price and value" is the mean of 1.5 and 1.0
    assert found == {"price": round((1.25 - 3.0) / 2, 3)}


def test_a_sentence_can_mention_several_aspects(spark):
    assert aspects_of(spark, "Battery has a sturdy price", "Electronics") == {
        "battery life": 1.5, "build quality": 1.5, "price": 1.5,
    }


def test_unknown_category_has_no_aspects(spark):
    assert aspects_of(spark, "Good price", "Garden") == {}
    assert aspects_of(spark, "", "Books") == {}


@pytest.mark.parametrize(
    "n_words, marks, has_aspect, score",
    [(0, 3, False, 0.0), (12, 2, False, 1.0), (12, 1, False, 0.5), (13, 2, False, 0.5), (13, 1, False, 0.0),
     (5, 5, True, 0.0)],
)
def test_generic_text(spark, n_words, marks, has_aspect, score):
    body = " ".join(["word"] * n_words) + "!" * marks
    assert evaluate(spark, text.generic_text_score(F.lit(body), F.lit(has_aspect))) == score


def test_whitespace_is_what_python_strips():
    assert all(c.isspace() for c in fixed.WHITESPACE)
