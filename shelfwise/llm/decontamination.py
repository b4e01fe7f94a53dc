"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A window is ten
consecutive words of a benchmark item; an item of fewer words is one window. Of the hashes of five consecutive words,
documents and items keep the smallest of every six in a row. Ten shared words hold six such hashes, and both sides
keep the same one of them, so every shared window meets in the join of kept hashes. For an item shorter than a
window the guarantee needs every hash of its own length: those are kept from the documents for the lengths that
occur among such items, nine at most.

A meeting is only a hit. It is extended along its diagonal, word by word, over the item's whole length, and what
counts is every window that agrees in all words. Only DataFrame functions are used. The join's small side is broadcast
after its size is measured; documents without a kept hash in common are not looked at again.

Defined results: a null or empty text has no words and no hits; an item without words is no window; repeated items
count each; an item without ``item_id`` counts as one without a name; every row is a document, also where rows share a
``doc_id`` or have none: rows are told apart by their id and text, and equal ones have equal results; an empty table gives
no rows, an empty benchmark no hits; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.corpus import lower_ascii
from shelfwise.sources.shared import broadcast_if_small, write_shared

WINDOW, GRAM = 10, 5
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = 1_000_000_000


def words_of(text: str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, _END)


def _with_pairs(df: DataFrame, name: str, left: str, right: str, by: int, how) -> DataFrame:
    """``name[i] = how(left[i], right[i + by])``; behind the end of ``right`` that is of null.

    Each array is a column of its own plan step, because one that is used twice must not be computed twice.
    """
    return df.withColumn(name, F.zip_with(F.col(left), _shifted(right, by), how))


def with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """For an array ``h`` of word hashes, arrays ``g<n>`` of the hashes of n consecutive words, for each length."""
    hashed = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("p1", F.col("h"))
    for size in (2, 4, 8):
        if size <= max(lengths, default=0):
            df = _with_pairs(df, f"p{size}", f"p{size // 2}", f"p{size // 2}", size // 2, hashed)
    for n in lengths:
        name, done = None, 0
        for size in (8, 4, 2, 1):
            if n & size:
                if name is None:
                    name = f"p{size}"
                else:
                    df = _with_pairs(df, f"t{n}_{size}", name, f"p{size}", done, hashed)
                    name = f"t{n}_{size}"
                done += size
        df = df.withColumn(f"g{n}", F.slice(name, 1, F.greatest(F.size("h") - (n - 1), F.lit(0))))
    return df


def with_kept(df: DataFrame, gram: int, window: int) -> DataFrame:
    """``kept``: the distinct minima of each ``window - gram + 1`` hashes in a row of ``g<gram>``."""
    least = lambda a, b: F.least(a, b)
    name, done, span = f"g{gram}", 1, window - gram + 1
    while done < span:
        step = min(done, span - done)
        df = _with_pairs(df, f"m{done + step}", name, name, step, least)
        name, done = f"m{done + step}", done + step
    return df.withColumn("kept", F.array_distinct(name))


def _tagged(grams: Column, n: int) -> Column:
    """Hashes of runs with their length, so that lengths don't meet."""
    return F.transform(grams, lambda gram: F.xxhash64(F.lit(n), gram))


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """``item, words, n, h`` of the items that have words, one row each."""
    worded = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words"))
    worded = worded.filter(F.size("words") > 0).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return worded.withColumn("n", F.size("words"))


def hit_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two frames: ``doc_id, n_words, copies`` of every document, and ``doc_id, item, start, length`` of every window that occurs.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``; ``start`` counts words from 0. Rows of one ``doc_id`` must have
    one text (``row_keys``); ``copies`` counts them.
    """
    # the number stands for an item in every join; its id is only a label
    numbered = benchmark_windows(benchmark, window, gram).withColumn("number", F.monotonically_increasing_id())
    items = write_shared(numbered, "items")
    short = sorted(r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect())
    lengths = sorted({gram, *short})
    spread = with_kept(with_grams(items, lengths), gram, window)
    own_length = reduce(
        lambda rest, n: F.when(F.col("n") == n, F.array(F.xxhash64(F.lit(n), F.get(f"g{n}", F.lit(0))))).otherwise(rest),
        short, F.col("kept"),
    )
    marks = spread.select("number", "n", *[f"g{n}" for n in lengths], own_length.alias("kept"))
    marks = write_shared(marks.select("number", "n", f"g{gram}", F.explode("kept").alias("mark")), "marks")

    worded = docs.select("doc_id", words_of("text").alias("words"))
    hashed = worded.select("doc_id", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    signed = with_kept(with_grams(hashed, lengths), gram, window)
    signed = signed.select("doc_id", "n_words", F.posexplode_outer(F.concat("kept", *[_tagged(F.array_distinct(f"g{n}"), n) for n in short])).alias("place", "mark"))
    wanted = broadcast_if_small(marks.select("mark").distinct().withColumn("met", F.lit(1)))
    met = signed.join(wanted, "mark", "left").groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.max("met").alias("met"), F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("copies")
    )
    met = write_shared(met, "met")

    suspects = broadcast_if_small(met.filter("met = 1").select("doc_id"))
    again = docs.select("doc_id", "text").join(suspects, "doc_id", "left_semi")
    again = write_shared(again.select("doc_id", words_of("text").alias("words")), "suspects")
    again = again.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    again = with_grams(again, lengths)
    tagged = [F.col(f"g{gram}"), *[_tagged(F.col(f"g{n}"), n) for n in short]]
    places = reduce(
        DataFrame.unionByName,
        [again.select("doc_id", F.xxhash64("words").alias("row"), F.posexplode(g).alias("at", "mark")) for g in tagged],
    )
    # where in the item a kept hash stands: each place for long items, the beginning for short ones
    index = F.when(F.col("n") < window, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.size(f"g{gram}") - 1), lambda i: F.get(f"g{gram}", i) == F.col("mark"))
    )
    placed = marks.select("number", "mark", F.explode(index).alias("item_at"))
    diagonals = places.join(broadcast_if_small(placed), "mark").select(
        "doc_id", "row", "number", (F.col("at") - F.col("item_at")).alias("shift")
    )
    diagonals = write_shared(diagonals.distinct(), "diagonals")

    rows = again.select("doc_id", F.xxhash64("words").alias("row"), F.col("words").alias("doc_words"))
    rows = rows.dropDuplicates(["doc_id", "row"])
    both = diagonals.join(rows, ["doc_id", "row"]).join(broadcast_if_small(items.select("number", "item", "n", F.col("words").alias("item_words"))), "number")
    # the item along the diagonal: 1 where the words agree, 0 elsewhere and outside the document
    first = F.greatest(F.col("shift"), F.lit(0))
    doc_part = F.slice("doc_words", first + 1, F.greatest(F.col("n") + F.least(F.col("shift"), F.lit(0)), F.lit(0)))
    item_part = F.slice("item_words", first - F.col("shift") + 1, _END)
    same = F.zip_with(item_part, doc_part, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    agree = both.select("doc_id", "item", "n", first.alias("first"), same.alias("e1"))
    name, done = "e1", 1
    while done < window:
        step = min(done, window - done)
        agree = _with_pairs(agree, f"e{done + step}", name, name, step, lambda a, b: F.least(a, F.coalesce(b, F.lit(0))))
        name, done = f"e{done + step}", done + step
    long_starts = F.filter(F.sequence(F.lit(0), F.size(name)), lambda i: F.get(name, i) == 1)
    whole = (F.size("e1") == F.col("n")) & F.forall("e1", lambda x: x == 1)
    starts = F.when(F.col("n") >= window, long_starts).when(whole, F.array(F.lit(0)))
    hits = agree.select(
        "doc_id", "item", "first", F.least(F.col("n"), F.lit(window)).alias("length"), name, F.explode(starts).alias("at")
    ).select("doc_id", "item", (F.col("first") + F.col("at")).alias("start"), "length")
    return met.select("doc_id", "n_words", "copies"), write_shared(hits, "hits")


def row_keys(docs: DataFrame) -> Column:
    """A text's 128-bit hash with the row's ``doc_id``, if it has one."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws(" ", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string"), F.col("doc_id").cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    kind = dict(docs.dtypes)["doc_id"]
    words, hits = hit_windows(docs.select(row_keys(docs).alias("doc_id"), "text"), benchmark, window, gram)
    covered = hits.select("doc_id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct()
    n_hit = covered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("doc_id", "item").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items")
    )
    hit = broadcast_if_small(write_shared(n_hit.join(named, "doc_id"), "hit"))
    none = F.lit(0).cast("long")
    hashes = F.substring_index("doc_id", " ", 2)
    own_id = F.when(F.col("doc_id") != hashes, F.expr("substring(doc_id, length(substring_index(doc_id, ' ', 2)) + 2)")).cast(kind)
    every = words.join(hit, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.select(
        own_id.alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; every row is judged by its own text."""
    _, hits = hit_windows(docs.select(row_keys(docs).alias("doc_id"), "text"), benchmark, window, gram)
    found = broadcast_if_small(write_shared(hits.select(F.col("doc_id").alias("key")).distinct(), "contaminated"))
    # the row as one column, so that its names can't clash
    rows = docs.select(row_keys(docs).alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(found, "key", "left_anti").select("row.*")
