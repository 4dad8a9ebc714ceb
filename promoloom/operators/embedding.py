"""Vectors of product names, and their principal components as features."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import (IDF, PCA, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StandardScaler)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import DEFAULTS
from ..storage import attach, bounded, settle


def hashed_ngrams(n: int = 3, features: int = 512) -> tuple[Callable[[DataFrame, str], object], str]:
    """Pipeline of character n-grams -> hashed counts -> IDF -> unit length."""
    def fit(df: DataFrame, text: str):
        stages = [
            SQLTransformer(statement=f"SELECT *, lower(coalesce({text}, '')) AS _txt FROM __THIS__"),
            RegexTokenizer(inputCol="_txt", outputCol="_chars", pattern="", minTokenLength=1),
            NGram(n=n, inputCol="_chars", outputCol="_grams"),
            HashingTF(numFeatures=features, inputCol="_grams", outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="vector"),
        ]
        return Pipeline(stages=stages).fit(df)

    return fit, "vector"


def encode_names(catalog: DataFrame, queries: DataFrame | None = None, n: int = 3,
                 features: int = 512) -> tuple[DataFrame, DataFrame | None]:
    """Unit vectors (``vec``, arrays) of catalog names and, with the same weights, query texts."""
    fit, column = hashed_ngrams(n, features)
    model = fit(catalog, "name")

    def run(df: DataFrame, text: str) -> DataFrame:
        named = df if text == "name" else df.withColumn("name", F.col(text))
        out = model.transform(named).withColumn("vec", vector_to_array(column))
        return out.select(*df.columns, "vec")

    return run(catalog, "name"), None if queries is None else run(queries, "text")


def encode_with(df: DataFrame, text: str, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
                batch: int = 64, name: str = "vec") -> DataFrame:
    """Add vectors from any encoder.

    ``make_predict`` loads the model, once a Python worker, and returns a function
    from an array of texts to a matrix with one row each.  Null texts are encoded as empty ones.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn(name, predict(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def name_terms(names: DataFrame, key: str, text: str = "name", n: int = 3, features: int = 512) -> DataFrame:
    """``key``, ``term``, ``weight``: unit vectors of hashed letter ``n``-grams with inverse frequencies, in column expressions.

    A term is a gram's hash in ``features`` places.  Names shorter than a gram,
    and null ones, have no terms.
    """
    low = F.lower(F.col(text))
    last = F.length(low) - F.lit(n - 1)
    grams = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))
    place = F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("bigint") % features
    counts = (names.filter(F.col(text).isNotNull()).select(key, F.explode(grams).alias("gram")).select(key, place.alias("term"))
              .groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))
    counts = settle(counts)
    whole = names.filter(F.col(text).isNotNull()).select(key).distinct().agg(F.count(F.lit(1)).alias("names"))
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = attach(seen, whole, []).select("term", F.log((F.col("names") + 1.0) / (F.col("df") + 1.0)).alias("idf"))
    weighed = counts.join(bounded(rare), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")).filter("length > 0")
    return weighed.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def projected(terms: DataFrame, key: str, dims: int = DEFAULTS.embedding_dims, seed: int = DEFAULTS.seed) -> DataFrame:
    """``key``, ``emb_0`` .. : sparse vectors on ``dims`` random directions of signs, which keep products on average.

    A term's sign in a direction is a hash, so no table of directions is needed.
    """
    def sign(i: int):
        odd = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("term").cast("string"), F.lit(str(i)), F.lit(str(seed)))), 1, 1), 16, 10)
        return F.when(odd.cast("int") % 2 == 0, 1.0).otherwise(-1.0)

    return terms.groupBy(key).agg(*[(F.sum(F.col("weight") * sign(i)) / math.sqrt(dims)).alias(f"emb_{i}") for i in range(dims)])


def name_components(catalog: DataFrame, dims: int = DEFAULTS.embedding_dims, n: int = 3,
                    features: int = 512) -> DataFrame:
    """sku, emb_0 .. emb_{dims-1}: principal components of the name vectors.

    The covariance is ``features`` x ``features`` whatever the catalog's size.
    """
    fit, column = hashed_ngrams(n, features)
    rows = catalog.filter(F.col("name").isNotNull()).select("sku", "name")
    vectors = fit(rows, "name").transform(rows).select("sku", column)
    dims = min(dims, features, vectors.count())
    scaled = StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="_c")
    parts = Pipeline(stages=[scaled, PCA(k=dims, inputCol="_c", outputCol="_pc")]).fit(vectors)
    out = parts.transform(vectors).withColumn("_a", vector_to_array("_pc"))
    return out.select("sku", *[F.col("_a")[i].alias(f"emb_{i}") for i in range(dims)])


def term_components(terms: DataFrame, key: str, dims: int = DEFAULTS.embedding_dims, features: int = 512) -> DataFrame:
    """``key``, ``emb_0`` .. : principal components of the sparse vectors of ``name_terms``.

    A name has at most ``features`` terms; the covariance is ``features`` x ``features`` whatever the number of names.
    """
    held = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(features - 1).cast("bigint"))
    dense = F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    vectors = settle(held.select(key, array_to_vector(dense).alias("vector")))
    dims = min(dims, features, vectors.count())
    scaled = StandardScaler(withMean=True, withStd=False, inputCol="vector", outputCol="_c")
    parts = Pipeline(stages=[scaled, PCA(k=dims, inputCol="_c", outputCol="_pc")]).fit(vectors)
    out = parts.transform(vectors).withColumn("_a", vector_to_array("_pc"))
    return out.select(key, *[F.col("_a")[i].alias(f"emb_{i}") for i in range(dims)])


def attach_components(features: DataFrame, components: DataFrame) -> DataFrame:
    """Left join on sku; a product without a vector gets zeros."""
    names = [c for c in components.columns if c.startswith("emb_")]
    return features.join(bounded(components), "sku", "left").fillna(0.0, subset=names)
