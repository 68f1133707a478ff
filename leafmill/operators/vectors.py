"""Vectors: exact cosine ranking of a stated query set, and a store of vectors as tables (upsert, delete, statistics).

Ranking holds the queries in blocks of ``BLOCK`` and multiplies each block with every batch of vectors, where these lie;
only the best of each batch are moved. A vector of zeros has similarity 0 to all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at once.
BLOCK = 10_000


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """(query, id, score, rank) from vectors and queries (id bigint, vector): the ``k`` nearest of each query, not
    counting itself unless asked; ties to the smaller id. The caller filters the vectors before, or the result after:
    these are two different questions. Vectors must have one length; null and empty ones are left out."""
    out = None
    rows = queries.where(F.size("vector") > 0).select("id", "vector").toLocalIterator()
    while held := [r for _, r in zip(range(BLOCK), rows)]:
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held]), _unit([r[1] for r in held])))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["id"].to_numpy()
                order = np.argsort(own, kind="stable")
                own, x = own[order], _unit(pdf["vector"].to_numpy()[order])
                s = np.round(q @ x.T, 12)
                if not itself:
                    s[ids[:, None] == own[None, :]] = -9
                n = min(k, s.shape[1])
                at = np.argsort(-s, axis=1, kind="stable")[:, :n]
                value = np.take_along_axis(s, at, axis=1)
                good = value > -2
                yield pd.DataFrame({"query": np.broadcast_to(ids[:, None], at.shape)[good], "id": own[at][good], "score": value[good]})

        found = vectors.where(F.size("vector") > 0).select("id", "vector").mapInPandas(best, "query bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, id bigint, score double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, cut to the shorter; 0 for a vector of zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + F.coalesce(t, F.lit(0.0)))
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def mock_vector(text: str, dim: int = 128, most: int = 5000) -> np.ndarray:
    """Counts of (code point + place) modulo ``dim`` over the first ``most`` characters, at unit length; zeros for no text."""
    c = np.frombuffer(text[:most].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    v = np.bincount((c + np.arange(len(c))) % dim, minlength=dim).astype(np.float64)
    n = np.linalg.norm(v)
    return v / n if n else v


def mock_slots(texts: DataFrame, key: str, text: str, dim: int = 128, most: int = 5000) -> DataFrame:
    """(key, vector): counts of (code point + place) modulo ``dim`` over the first ``most`` characters, at unit length.

    An empty or null text has zeros only.
    """

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [mock_vector(t if isinstance(t, str) else "", dim, most) for t in pdf["_t"]]
            yield pd.DataFrame({key: pdf[key], "vector": out})

    own = texts.select(F.col(key), F.col(text).alias("_t"))
    return own.mapInPandas(embed, f"{key} {own.schema[key].dataType.simpleString()}, vector array<double>")


def upsert(store: DataFrame, new: DataFrame, key: str = "chunk_id", place: str = "ordinal") -> DataFrame:
    """The store with the new rows in: a key that is there keeps its place and gets the new values, others follow in
    their order. Of several new rows under one key the last counts. Both have the same columns and ``place``."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(place)))).where("_r = 1").drop("_r")
    most = store.agg(F.coalesce(F.max(place), F.lit(-1)).alias("_most"))
    old = store.alias("o").join(last.alias("n"), key, "full_outer").crossJoin(F.broadcast(most))
    columns = [c for c in store.columns if c not in (key, place)]
    known = F.col(f"o.{place}").isNotNull()
    fresh = F.col(f"n.{place}").isNotNull()
    return old.select(key, F.when(known, F.col(f"o.{place}")).otherwise(F.col(f"n.{place}") + F.col("_most") + 1).alias(place), *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def delete(store: DataFrame, ids: DataFrame | None = None, source: str | None = None, ids_first: bool = False) -> DataFrame:
    """The store without the chunks of ``ids`` (chunk_id) or of the source; with ``ids_first`` the source only counts
    where no ids are given."""
    out = store
    if ids is not None:
        out = out.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    if source is not None and not (ids_first and ids is not None):
        out = out.where(~F.coalesce(F.col("source_id") == source, F.lit(False)))
    return out


def cache_key(provider: str, model: str, text: Column) -> Column:
    """Key of an embedding in a cache."""
    return F.concat(F.lit(f"{provider}:{model}:"), F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def cache_misses(texts: DataFrame, cache: DataFrame, provider: str, model: str, text: str = "text") -> DataFrame:
    """(cache_key, text): distinct texts that the cache (cache_key) does not have."""
    return texts.select(cache_key(provider, model, F.col(text)).alias("cache_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct().join(cache.select("cache_key"), "cache_key", "left_anti")


def save(store: DataFrame, path: str) -> None:
    """Write a store, chunks with their vectors, as a table; what is there is replaced."""
    store.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """A store that was written."""
    return spark.read.parquet(path)


def embedded(texts: DataFrame, key: str, text: str, embed: Callable[[list[str]], list], fallback: bool = True, dim: int = 128) -> DataFrame:
    """(key, vector, provider): vectors of a function that takes a batch of texts. Where it fails on a batch that batch gets
    mock vectors, unless ``fallback`` is off; blank texts, which such functions refuse, always do."""
    own = texts.select(key, F.col(text).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = [t if isinstance(t, str) else "" for t in pdf["_t"]]
            full = [i for i, t in enumerate(asked) if t.strip()]
            vectors, names = [mock_vector(t, dim) for t in asked], ["mock"] * len(asked)
            try:
                for i, v in zip(full, embed([asked[i] for i in full]) if full else []):
                    vectors[i], names[i] = np.asarray(v, dtype=np.float64), "given"
            except Exception:
                if not fallback:
                    raise
            yield pd.DataFrame({key: pdf[key], "vector": vectors, "provider": names})

    return own.mapInPandas(run, f"{key} {own.schema[key].dataType.simpleString()}, vector array<double>, provider string")
