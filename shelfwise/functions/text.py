"""Tokenizers, sentence splitting, slugs, lexicon sentiment and aspect opinions.

Everything here stays inside one row: no explode, no shuffle, no Python worker.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.rounding import round_exact


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is evaluated again for every array element once the optimizer has
    merged the projections. A lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.SEARCH_TOKEN_PATTERN), F.lit(0))


def review_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.REVIEW_TOKEN_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    parts = F.split(text, fixed.SENTENCE_BREAK_PATTERN)
    trimmed = F.transform(parts, lambda s: F.btrim(s, F.lit(fixed.WHITESPACE)))
    return F.filter(trimmed, lambda s: s != "")


def term_counts(tokens: Column) -> Column:
    """Distinct tokens with their number of occurrences, counted inside the row from sorted runs."""

    def runs(ordered: Column) -> Column:
        last_of_run = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda p: ~F.get(ordered, p - 1).eqNullSafe(F.get(ordered, p)),
        )

        def counted(ends: Column) -> Column:
            return F.transform(
                ends,
                lambda end, k: F.struct(
                    F.get(ordered, end - 1).alias("term"),
                    (end - F.coalesce(F.get(ends, k - 1), F.lit(0))).alias("tf"),
                ),
            )

        return F.when(F.size(ordered) > 0, bind(last_of_run, counted))

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.coalesce(bind(F.sort_array(tokens), runs), empty)


def embedding_text(title: Column, description: Column) -> Column:
    return F.concat_ws(". ", title, description)


def search_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", title, description)


def slugify(label: Column) -> Column:
    dashed = F.regexp_replace(F.replace(F.lower(label), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def diversity_key(category: Column, title: Column) -> Column:
    first_word = F.lower(F.get(F.split(title, " "), F.lit(0)))
    return F.concat(category, F.lit("::"), first_word)


def significant_words(phrase: Column, stopwords: Sequence[str] = fixed.PHOTO_STOPWORDS) -> Column:
    return F.array_except(ascii_words(phrase), F.array(*[F.lit(w) for w in stopwords]))


def ascii_words(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters."""
    runs = F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0))
    return F.array_distinct(F.transform(runs, F.lower))


def image_prompt(title: Column, category: Column, material: Column) -> Column:
    return F.format_string(fixed.IMAGE_PROMPT, F.lower(title), F.lower(category), F.lower(material))


def image_seed(product_id: Column) -> Column:
    first_hex_digits = F.substring(F.sha2(product_id.cast("string"), 256), 1, 8)
    return F.conv(first_hex_digits, 16, 10).cast("long")


@dataclass(frozen=True)
class Lexicon:
    """Word polarities plus the words that flip or scale the polarity after them."""

    polarity: Mapping[str, float] = field(default_factory=lambda: fixed.POLARITY)
    intensifiers: Mapping[str, float] = field(default_factory=lambda: fixed.INTENSIFIERS)
    negations: Sequence[str] = field(default_factory=lambda: fixed.NEGATIONS)

    def weights(self) -> dict[str, float]:
        """Polarity words that are not claimed by one of the two modifier lists."""
        modifiers = set(self.intensifiers) | set(self.negations)
        return {w: p for w, p in self.polarity.items() if w not in modifiers}

    @property
    def size(self) -> int:
        return len(self.weights()) + len(self.intensifiers)


def _lookup(word: Column, table: Mapping[str, float]) -> Column:
    """The number a word stands for, else null: one hashed IN test per distinct number.

    A literal map would be searched linearly for every word of every text.
    """
    words_by_number: dict[float, list[str]] = defaultdict(list)
    for key, number in table.items():
        words_by_number[float(number)].append(key)
    if not words_by_number:
        return F.lit(None).cast("double")
    chain = F
    for number, words in words_by_number.items():
        chain = chain.when(word.isin(words), F.lit(number))
    return chain


def sentiment(text: Column, lexicon: Lexicon = Lexicon(), negation_reach: int = 3) -> Column:
    """Mean signed polarity of the polarity words of a text, 0 when there are none.

    The word directly before may scale it, and a negation among the ``negation_reach`` words before
    flips it.
    """
    weights = lexicon.weights()

    def polarity_of(tokens: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            scale = F.coalesce(_lookup(F.get(tokens, i - 1), lexicon.intensifiers), F.lit(1.0))
            before = F.slice(
                tokens, F.greatest(i - (negation_reach - 1), F.lit(1)), F.least(i, F.lit(negation_reach))
            )
            negated = F.exists(before, lambda w: w.isin(list(lexicon.negations)))
            sign = F.when(negated, -1.0).otherwise(1.0)
            return F.when(token.isin(list(weights)), sign * _lookup(token, weights) * scale)

        return F.array_compact(F.transform(tokens, one))

    return F.coalesce(bind(bind(review_tokens(text), polarity_of), mean_of), F.lit(0.0))


def mean_of(values: Column) -> Column:
    """Mean of an array of doubles, added up in order; null for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def aspect_opinions(
    body: Column,
    category: Column,
    keywords: Mapping[str, Mapping[str, Sequence[str]]] = fixed.ASPECT_KEYWORDS,
    lexicon: Lexicon = Lexicon(),
    digits: int | None = 3,
) -> Column:
    """Map from aspect to the mean sentiment of the sentences that mention it.

    A sentence mentions an aspect when its lower-cased text contains one of the aspect's triggers,
    anywhere, also inside a word. The trigger table is a bounded parameter and travels as a literal.
    """
    pairs = []
    for name, aspects in keywords.items():
        entries = [
            F.struct(F.lit(aspect).alias("aspect"), F.array(*[F.lit(t) for t in triggers]).alias("triggers"))
            for aspect, triggers in aspects.items()
        ]
        pairs += [F.lit(name), F.array(*entries)]
    table = F.create_map(*pairs)

    def judged(wanted: Column) -> Column:
        """Which aspects each sentence mentions, and its score if it mentions any."""

        def hits(lowered: Column) -> Column:
            return F.transform(
                wanted, lambda a: F.exists(a["triggers"], lambda t: F.contains(lowered, t))
            )

        def judge(sentence: Column) -> Column:
            return bind(
                bind(F.lower(sentence), hits),
                lambda hit: F.struct(
                    hit.alias("hit"), F.when(F.exists(hit, lambda h: h), sentiment(sentence, lexicon)).alias("score")
                ),
            )

        return F.transform(sentences(body), judge)

    def opinions(wanted: Column) -> Column:
        def per_aspect(found: Column) -> Column:
            def one(aspect: Column, k: Column) -> Column:
                scores = F.transform(F.filter(found, lambda s: F.get(s["hit"], k)), lambda s: s["score"])
                return F.struct(
                    aspect["aspect"].alias("key"), round_exact(bind(scores, mean_of), digits).alias("value")
                )

            return F.filter(F.transform(wanted, one), lambda e: e["value"].isNotNull())

        return bind(judged(wanted), per_aspect)

    no_opinions = F.array().cast("array<struct<key:string,value:double>>")
    return F.map_from_entries(F.coalesce(bind(F.try_element_at(table, category), opinions), no_opinions))


def generic_text_score(body: Column, has_aspect: Column, max_tokens: int = 12, min_exclamations: int = 2) -> Column:
    """1 for short and exclaiming text that names no aspect, 0.5 when only one of the two holds."""

    def score(n_tokens: Column) -> Column:
        short = n_tokens <= max_tokens
        punchy = F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))) >= min_exclamations
        return (
            F.when((n_tokens == 0) | has_aspect, 0.0)
            .when(short & punchy, 1.0)
            .when(short | punchy, 0.5)
            .otherwise(0.0)
        )

    return bind(F.size(review_tokens(body)), score)
