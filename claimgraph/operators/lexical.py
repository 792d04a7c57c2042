"""Full-text search: postings and BM25 as joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import searchable, tokens
from claimgraph.operators.links import stored

K1, B, TOP = 1.2, 0.75, 8


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): a row for each distinct term of a document; only of ``terms`` (term) where these are given."""
    rows = docs.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    rows = rows.select("key", "dl", F.explode("t").alias("term"))
    rows = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl): how many terms each document has."""
    return docs.select(F.col(key).alias("key"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(searchable(F.col("query"))))).alias("term"))


def search(docs: DataFrame, key: str, text: str, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``bm25`` over a table's texts: only the queries' terms become postings, which are written once."""
    terms = query_terms(queries)
    return bm25(stored(postings(docs, key, text, terms)), lengths(docs, key, text), queries, top)


def bm25(index: DataFrame, sizes: DataFrame, queries: DataFrame, top: int = TOP, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, key, score) for (query_id, query): distinct query terms, the best ``top`` documents, ties by key.

    ``index``: postings, at least of the queries' terms; ``sizes`` (key, dl) of all documents, empty ones too, for the averages.
    Postings are dealt by document once, before they meet the queries: a document's scores and each task's best are then found in place.
    """
    terms = query_terms(queries)
    whole = sizes.agg(F.count("*").alias("n"), F.sum("dl").alias("all_terms"))  # one row
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(whole)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("all_terms") / F.col("n")).alias("avgdl"))
    hits = index.repartition("key").join(stored(terms.join(idf, "term")), "term")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "key").agg(F.round(F.sum(F.col("idf") * tf), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "key", "score")
