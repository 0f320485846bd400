"""Named functions that users can add to: embedders, quantifiers, alignments, normalisers, tokenizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicons import ARGUMENT_MARKERS, STRUCTURE_MARKERS


class Registry:
    """Functions by name.  Those that came with the library take precedence over added ones."""

    def __init__(self, kind: str, built_in: dict[str, Callable[..., Any]]):
        self.kind, self.built_in, self.added = kind, built_in, {}

    def register(self, name: str, function: Callable[..., Any]) -> None:
        self.added[name] = function

    def get(self, name: str) -> Callable[..., Any]:
        found = self.built_in.get(name) or self.added.get(name)
        if found is None:
            raise ValueError(f"no {self.kind} named {name}; there are {', '.join(self.available())}")
        return found

    def available(self) -> list[str]:
        return sorted({*self.built_in, *self.added})


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """Unit vector of a text without a model: every word adds 1 or -1 at a place given by its MD5; zero
    for a text without words."""
    import hashlib
    import re

    v = np.zeros(dim)
    for w in re.findall(r"[^\W_]+", text.lower()):
        d = hashlib.md5(w.encode()).hexdigest()
        v[int(d[:4], 16) % dim] += 1.0 if d[4] < "8" else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def hashing(text: Column, dim: int = 64) -> Column:
    """Deterministic offline embedder; null texts have null vectors."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else hashed_vector(t, dim) for t in texts], dtype=object)

    return embed(text)


EMBEDDERS = Registry("embedder", {"hashing": hashing})


def embed_texts(df: DataFrame, text: str, into: str = "embedding", model: str = "hashing", **options) -> DataFrame:
    """``df`` with a vector of each text.  Every distinct text is encoded once."""
    key = F.md5(F.concat(F.lit(f"{model}:"), F.col("__t")))
    texts = df.select(F.col(f"`{text}`").alias("__t")).where("__t is not null").distinct().withColumn("__key", key)
    encoded = texts.select("__key", EMBEDDERS.get(model)(F.col("__t"), **options).alias(into))
    keyed = df.drop(into).withColumn("__key", F.md5(F.concat(F.lit(f"{model}:"), F.col(f"`{text}`"))))
    return keyed.join(encoded, "__key", "left").drop("__key")


def embed_cached(df: DataFrame, text: str, cache: str, into: str = "embedding", model: str = "hashing", **options) -> DataFrame:
    """As ``embed_texts``, with the vectors kept in a Parquet table at ``cache``: only texts it does not
    hold are encoded and added."""
    spark = df.sparkSession
    schema = "key string, vector array<double>"
    texts = df.select(F.col(f"`{text}`").alias("t")).where("t is not null").distinct().withColumn("key", F.md5(F.concat(F.lit(f"{model}:"), F.col("t"))))
    from tessera.storage import list_paths

    held = spark.read.schema(schema).parquet(cache) if list_paths(spark, cache) else spark.createDataFrame([], schema)
    fresh = texts.join(held.select("key"), "key", "left_anti")
    fresh.select("key", EMBEDDERS.get(model)(F.col("t"), **options).alias("vector")).write.mode("append").parquet(cache)
    vectors = spark.read.schema(schema).parquet(cache).groupBy("key").agg(F.any_value("vector").alias(into))
    return df.drop(into).withColumn("key__", F.md5(F.concat(F.lit(f"{model}:"), F.col(f"`{text}`")))).join(vectors, F.col("key__") == F.col("key"), "left").drop("key", "key__")


def faceted(definition: Column, usage: Column, relational: Column, model: str = "hashing", **options) -> Column:
    """struct of the vectors of three facets."""
    encode = EMBEDDERS.get(model)
    return F.struct(*[encode(c, **options).alias(n) for n, c in (("definition", definition), ("usage", usage), ("relational", relational))])


#: Each takes a text column and gives a dict of feature columns.
QUANTIFIERS = Registry(
    "quantifier",
    {
        "lexical": lambda t: {n: T.lexical_features(t, ARGUMENT_MARKERS)[n] for n in ("n_tokens", "n_types", "ttr", "hapax_ratio", "mean_length", "marker_density", "n_sentences", "long_share")},
        "plain": lambda t: T.plain_features(t),
        "structural": lambda t: T.structural_features(t, STRUCTURE_MARKERS),
    },
)


def quantify(df: DataFrame, text: str, kinds: list[str]) -> DataFrame:
    """``df`` with the features of each kind in columns kind_feature."""
    features = {f"{k}_{n}": c for k in kinds for n, c in QUANTIFIERS.get(k)(F.col(f"`{text}`")).items()}
    return df.withColumns(features)


#: Each takes a text column and gives an array of tokens.
TOKENIZERS = Registry(
    "tokenizer",
    {
        "whitespace": lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != ""),
        "characters": lambda t: F.filter(F.split(t, ""), lambda c: ~c.rlike(r"^\s*$")),
        "words": T.tokens,
    },
)
#: Tokenizer by language; others split at blanks.
LANGUAGE_TOKENIZERS = {"zh": "characters", "ja": "characters", "ko": "whitespace"}


def tokenizer_for(language: str) -> Callable[[Column], Column]:
    """The tokenizer of a language: an added one of that name, or the built-in choice."""
    return TOKENIZERS.added.get(language) or TOKENIZERS.get(LANGUAGE_TOKENIZERS.get(language, "whitespace"))


NORMALISERS = Registry("normaliser", {"default": T.nfc, "greek": T.bare_greek, "kanbun": T.kanbun_lines})
#: Each takes a table of pairs (a, b) and gives it scored.
ALIGNMENTS = Registry("alignment", {})
