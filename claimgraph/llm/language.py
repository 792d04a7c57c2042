"""Language ID by rank-order profiles (operator 6).

A profile lists a language's most frequent 1- to 3-grams of letters, words padded with blanks. A text is ranked the
same way over its whole length, and the language with the smallest out-of-place distance wins: the sum over the
text's top n-grams of the difference of ranks, or of the profile's size where the profile lacks the n-gram.

Profiles are learned from at most about ``SAMPLE`` distinct texts per language, chosen by a hash of the text over all
training rows; that bound is a parameter. What the driver and each executor hold is bounded by languages x ranks.

Defined cases: a null text and one without letters are ``und`` with score 0; so is every text if nothing could be
learned; ties go to the language that sorts first; repeated rows are judged alike; a null id is never learned from and
counts as held out; an empty table gives no rows; extra columns are ignored, those named like results give way. Score: 1 minus the best distance over the
second best (1 if only one language is known).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import bucket_of, table

RANKS = 400
SAMPLE = 2000
FOLDS, HELD_OUT = 4, 2
SAMPLE_TASKS = 32
BLOCK = 100_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else a blank."""
    if not _LETTERS:
        codes = np.arange(0x110000, dtype=np.uint32)
        known = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)
        _LETTERS.append(np.where(known, codes, np.uint32(32)))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the text's words; none if it has no letter."""
    c = _letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = c == 32
    keep = ~(blank[1:] & blank[:-1])
    c = np.r_[c[:1], c[1:][keep]]
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = [_counted(c[i : i + BLOCK + 2], BLOCK) for i in range(0, len(c), BLOCK)]  # so that a very long text takes no more memory
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _counted(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams that start at the first ``n`` places; a 3-gram's middle is a letter."""
    c = c.astype(np.uint64)
    blank = c == 32
    two = c[:-1] | c[1:] << np.uint64(21)
    three = (two[:-1] | c[2:] << np.uint64(42))[:n][~blank[1:-1][:n]]
    return np.unique(np.concatenate([c[:n][~blank[:n]], two[:n], three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * ranks:
        least = -np.partition(-counts, ranks - 1)[ranks - 1]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:ranks]]


class Profiles:
    """Ranks of all languages in one table: a row for each n-gram of any profile."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int):
        self.names, self.ranks = sorted(profiles), ranks
        self.codes = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.zeros(0, np.uint64)
        self.table = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, n in enumerate(self.names):
            self.table[np.searchsorted(self.codes, profiles[n]), j] = np.arange(len(profiles[n]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text) if text else ((), ())
        if not len(codes) or not self.names:
            return "und", 0.0
        first = top(codes, counts, self.ranks)
        at = np.searchsorted(self.codes, first)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != first)] = len(self.codes)
        there = self.table[at]
        away = np.where(there < 0, self.ranks, np.abs(there - np.arange(len(first))[:, None])).sum(axis=0)
        best = int(away.argmin())
        second = int(np.delete(away, best).min()) if len(away) > 1 else 0
        return self.names[best], float(1 - away[best] / second) if second else float(len(away) == 1)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The profile of each language in ``docs``."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    part = F.lit(float(sample)) / F.greatest(F.col("n"), F.lit(1)) * F.lit(2.0**20)
    chosen = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(2**20)) < part)  # one row a language
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text").repartition(SAMPLE_TASKS)

    def count(batches):
        totals: dict[str, dict[int, int]] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                mine = totals.setdefault(lang, {})
                for code, n in zip(*(a.tolist() for a in grams(text))):
                    mine[code] = mine.get(code, 0) + n
        if totals:
            yield pd.DataFrame({"lang": list(totals), "codes": [list(v) for v in totals.values()], "counts": [list(v.values()) for v in totals.values()]})

    sums: dict[str, list] = {}
    for lang, codes, counts in chosen.mapInPandas(count, "lang string, codes array<long>, counts array<long>").toLocalIterator():
        sums.setdefault(lang, []).append((np.array(codes, np.uint64), np.array(counts, np.int64)))
    out = {}
    for lang, parts in sums.items():
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
        if len(codes):
            out[lang] = top(codes, counts, ranks)
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """``docs`` with lang_pred and score; all its other columns are kept."""
    judge = _judge(docs, profiles, ranks)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_judged")]
    return docs.select(*kept, judge(F.col(text_col).cast("string")).alias("_judged")).select(*kept, "_judged.lang_pred", "_judged.score")


def _judge(docs: DataFrame, profiles: dict[str, np.ndarray], ranks: int):
    shared = docs.sparkSession.sparkContext.broadcast((profiles, ranks))
    made: list[Profiles] = []

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(Profiles(*shared.value))
        return pd.DataFrame([made[0].predict(t) for t in texts], columns=["lang_pred", "score"])

    return judge


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(bucket_of(id_col, FOLDS) != HELD_OUT)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    profiles = learn(training_rows(docs))
    return identify(docs.select("doc_id", held_out, "text"), profiles).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language: those without letters go. Columns as before."""
    judge = _judge(docs, learn(training_rows(docs, id_col), text_col, lang_col), RANKS)
    return docs.withColumn("_judged", judge(F.col(text_col).cast("string"))).filter("_judged.lang_pred <> 'und'").drop("_judged")
