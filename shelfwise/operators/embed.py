"""Batch text embedding, and the work list of products that still need an image."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import fixed_values as fixed
from shelfwise.functions.text import embedding_text, image_prompt, image_seed
from shelfwise.operators.blocks import text_slices

#: Characters of the texts that the encoder gets at a time.
ENCODED_CHARS = 500_000

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashed_encoder(dim: int = 64) -> Encoder:
    """Encoder without a model: every token adds or subtracts 1 at a place given by its MD5 digest."""

    @lru_cache(maxsize=100_000)
    def place(token: str) -> tuple[int, float]:
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) < 8 else -1.0

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        found = [re.findall(fixed.SEARCH_TOKEN_PATTERN, text.lower()) for text in texts]
        tokens = np.array([token for each in found for token in each], object)
        code, distinct = pd.factorize(tokens)
        if len(distinct):
            at, sign = (np.array(x) for x in zip(*map(place, distinct), strict=True))
            np.add.at(out, (np.repeat(np.arange(len(texts)), [len(each) for each in found]), at[code]), sign[code])
        return out

    return encode


def embed_texts(
    texts: DataFrame,
    make_encoder: Callable[[], Encoder] = hashed_encoder,
    digits: int | None = fixed.EMBEDDING_DIGITS,
) -> DataFrame:
    """``texts(id, text)`` to ``(id, vector)`` of unit length.

    ``make_encoder`` runs once per task and loads the model there; the encoder then gets batches of many texts, which are
    bounded in characters, so that its memory does not grow with the table or its texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for part in text_slices([len(t) for t in texts], ENCODED_CHARS):
                raw = np.asarray(encode(texts[part]), dtype=float)
                norm = np.linalg.norm(raw, axis=1, keepdims=True)
                unit = raw / np.where(norm == 0, 1.0, norm)
                if digits is not None:
                    unit = np.round(unit, digits)
                yield pd.DataFrame({"id": batch["id"].iloc[part], "vector": list(unit)})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<double>")


def embed_products(products: DataFrame, make_encoder: Callable[[], Encoder] = hashed_encoder) -> DataFrame:
    text = embedding_text(F.col("title"), F.col("description"))
    return embed_texts(products.select("id", text.alias("text")), make_encoder)


def pending_images(products: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Prompt and seed of the products that are not in ``done(id)``; all products without ``done``."""
    pending = products if done is None else products.join(done, "id", "left_anti")
    return pending.select(
        "id",
        image_prompt(F.col("title"), F.col("category"), F.col("material")).alias("prompt"),
        image_seed(F.col("id")).alias("seed"),
    )
