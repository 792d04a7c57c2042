"""Vectors: a replaceable embedder, and exact cosine top-k."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 384


def hashed_ngrams(text: str, dim: int = DIM) -> list[float]:
    """A deterministic unit vector: signed hashes of a text's character 3-grams, padded with blanks."""
    v = np.zeros(dim)
    padded = f"  {text.lower()} "
    for i in range(len(padded) - 2):
        h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).astype(np.float32).tolist()


def embed(text: str) -> Column:
    """The default embedder of a text column, made when asked for as it needs a session; a null text has the zero vector."""

    @F.pandas_udf("array<float>")
    def vectors_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashed_ngrams(t or ""))

    return vectors_of(text)


def vector_table(rows: DataFrame, key: str, text: Column, embedder=embed) -> DataFrame:
    """(key, vector): each distinct text is embedded once."""
    return text_vectors(rows, key, text, embedder).select("key", "vector")


def text_vectors(rows: DataFrame, key: str, text: Column, embedder=embed) -> DataFrame:
    """(key, text, vector)."""
    keyed = rows.select(F.col(key).alias("key"), text.alias("text"))
    return keyed.join(keyed.select("text").distinct().withColumn("vector", embedder("text")), "text").select("key", "text", "vector")


def upserted(stored: DataFrame, rows: DataFrame, key: str, text: Column, embedder=embed) -> DataFrame:
    """A stored index (key, text, vector) brought up to date: only keys that are new or whose text changed are embedded, gone ones go."""
    wanted = rows.select(F.col(key).alias("key"), text.alias("text"))
    kept = stored.join(wanted, ["key", "text"], "left_semi").select("key", "text", "vector")
    new = wanted.join(stored.select("key", "text"), ["key", "text"], "left_anti")
    return kept.unionByName(text_vectors(new, "key", F.col("text"), embedder))


QUERY_BLOCK = 1024


def top_k(queries: DataFrame, index: DataFrame, k: int, floor: float | None = None, block: int = 4096) -> DataFrame:
    """(query_id, rank, key, score) from (query_id, vector) and (key, vector): the k best by cosine clamped to [0, 1], ties by key.

    Queries go in blocks of ``QUERY_BLOCK`` against all rows of the index: a block is shared with the executors, a block of the index's rows is one
    matrix and gives its own k best for each query, so that no pair is a row and only k rows a query and index block are shuffled.
    """
    out, rows = None, queries.select("query_id", F.col("vector").cast("array<double>").alias("v")).toLocalIterator()
    while asked := [r for _, r in zip(range(QUERY_BLOCK), rows)]:
        found = _block_top_k(asked, queries.schema["query_id"].dataType.simpleString(), index, k, block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = queries.select("query_id").limit(0).join(index.select("key").limit(0)).withColumn("score", F.lit(0.0))
        return _ranked(empty, k, floor)
    return _ranked(out, k, floor)


def _block_top_k(asked: list, id_kind: str, index: DataFrame, k: int, block: int) -> DataFrame:
    key_kind = index.schema["key"].dataType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(([r["query_id"] for r in asked], np.array([r["v"] for r in asked], np.float64)))

    def best(batches):
        ids, q = shared.value
        qn = np.linalg.norm(q, axis=1)
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                x = np.array(part["vector"].tolist(), np.float64)
                norms = qn[:, None] * np.linalg.norm(x, axis=1)[None, :]
                s = np.round(np.clip(np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0), 0, 1), 6)
                keys = part["key"].to_numpy()
                for i, row in enumerate(s):
                    order = np.lexsort((keys, -row))[:k]
                    yield pd.DataFrame({"query_id": ids[i], "key": keys[order], "score": row[order]})

    return index.select("key", "vector").mapInPandas(best, f"query_id {id_kind}, key {key_kind}, score double")


def _ranked(scored: DataFrame, k: int, floor: float | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    out = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    return (out if floor is None else out.filter(F.col("score") >= floor)).select("query_id", "rank", "key", "score")
