"""Extraction quality against gold triples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import evaluated_name, evaluated_predicate
from claimgraph.operators.vectors import hashed_ngrams

SAME_PREDICATE = 0.60


def normalised(triples: DataFrame) -> DataFrame:
    return triples.withColumn("s", evaluated_name(F.col("subject"))).withColumn("o", evaluated_name(F.col("object"))).withColumn("p", evaluated_predicate(F.col("predicate")))


def greedy_match(gold: DataFrame, found: DataFrame, embedder=hashed_ngrams, floor: float = SAME_PREDICATE) -> DataFrame:
    """Per gold row (doc, pos): the extracted row taken (or null), whether ends were reversed, the cosine, and whether the triple counts.

    Gold rows choose in order; rows with the same ends come before reversed ones; of these the best predicate, the first of
    equals; each extracted row is taken once. The choice depends on order, so a document is one group.
    """
    known: dict[str, np.ndarray] = {}

    def vector(p: str) -> np.ndarray:
        if p not in known:
            if len(known) > 100_000:
                known.clear()
            known[p] = np.asarray(embedder(p), np.float64)
        return known[p]

    def one(doc, gold_rows: list, found_rows: list) -> list:
        ends: dict[tuple, list] = {}
        for r in found_rows:
            ends.setdefault((r.s, r.o), []).append(r)
        taken: set[int] = set()
        rows = []
        for r in gold_rows:
            row = (doc, r.pos, None, False, 0.0, False)
            for reverse in (False, True):
                free = [x for x in ends.get((r.o, r.s) if reverse else (r.s, r.o), []) if x.pos not in taken]
                if free:
                    sims = [float(vector(r.p) @ vector(x.p)) for x in free]
                    best = int(np.argmax(sims))
                    taken.add(free[best].pos)
                    row = (doc, r.pos, free[best].pos, reverse, round(sims[best], 6), sims[best] >= floor)
                    break
            rows.append(row)
        return rows

    def match(batches):
        doc, sides = None, ([], [])
        for pdf in batches:
            rows: list = []
            for r in pdf.itertuples():
                if doc is not None and r.doc != doc:
                    rows += one(doc, *sides)
                    sides = ([], [])
                doc = r.doc
                sides[r.side].append(r)
            yield _matches(rows)
        if doc is not None:
            yield _matches(one(doc, *sides))

    kind = gold.schema["doc"].dataType.simpleString()
    columns = ["doc", "pos", "s", "o", "p"]
    both = normalised(gold).select(*columns, F.lit(0).alias("side")).unionByName(normalised(found).select(*columns, F.lit(1).alias("side")))
    both = both.filter("doc IS NOT NULL").repartition("doc").sortWithinPartitions("doc", "side", "pos")
    return both.mapInPandas(match, f"doc {kind}, pos long, found_pos long, reversed boolean, cosine double, triple boolean")


def _matches(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc", "pos", "found_pos", "reversed", "cosine", "triple"])
    return out.astype({"found_pos": "Int64"})


def precision_recall(n_gold, n_found, n_hit) -> list:
    """Columns precision, recall and f1 from counts, rounded to 3 places; 0 where a divisor is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(n_hit, n_found), ratio(n_hit, n_gold)
    return [F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 3).alias("f1")]


def report(gold: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Micro averages over all documents, for pairs of ends and for triples."""
    counts = gold.agg(F.count("*").alias("n_gold")).crossJoin(found.agg(F.count("*").alias("n_found")))
    hits = matches.agg(F.count("found_pos").alias("pair"), F.count_if("triple").alias("triple"))
    rows = hits.select(F.expr("stack(2, 'pair', pair, 'triple', triple) AS (level, n_hit)")).crossJoin(counts)
    return rows.select("level", "n_gold", "n_found", "n_hit", *precision_recall(F.col("n_gold"), F.col("n_found"), F.col("n_hit")))
