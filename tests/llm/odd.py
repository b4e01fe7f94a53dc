"""Small tables with what real ones may hold: nulls, empty and long texts, repeats, and columns of clashing names."""

from __future__ import annotations

import random

#: Also names that the operators use for columns of their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, line string, words string, gone string"


def words(seed: int, count: int, prefix: str = "") -> list[str]:
    rng = random.Random(seed)
    return [prefix + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(count)]


def text(seed: int, count: int) -> str:
    return " ".join(words(seed, count))


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = [w if i % 9 else "other" + w for i, w in enumerate(base)]
    return [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, " ".join(far)),
        (5, None),
        (6, ""),
        (7, "   \n \t"),
        (8, "one two"),
        (9, "ONE  two"),
        (10, text(2, 20_000)),
        (11, "É é ß 漢字 \U0001f600 x́ " + text(3, 40)),
        (12, "line of text that is long enough to count as a line\n" + text(4, 30) + "\nline of text that is long enough to count as a line"),
        (13, "line of text that is long enough to count as a lime\n" + text(5, 30)),
        (14, "!!! ??? 123 456"),
        (14, "a second text of the same number " + text(6, 30)),
        (None, text(7, 25)),
        (15, text(8, 25)),
        (15, text(8, 25)),
        (1000, "a\x00b\tc d  e\n\nf\x1fg <|endoftext|> 's it's"),
    ]


def documents(spark, rows=None):
    langs = ["en", "fr", None]
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(d, t, langs[i % 3], f"s{i % 2}" if i % 5 else None, len(t or ""), 7, 8, "line", "words", "gone") for i, (d, t) in enumerate(rows)],
        SCHEMA,
    )


def empty(spark):
    return documents(spark, [])
