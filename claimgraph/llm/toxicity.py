"""Toxicity by compression distance (operator 1).

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Each window of ``WINDOW`` words of a
text is compressed with the ordinary dictionary alone and with the toxic one beside it; how many bytes that saves is the window's
distance (two dictionaries of unlike text, each alone, differ by chance on every window). A text's largest saving and what
its windows save from a calibrated threshold on give a probability by logistic calibration. Every window starts with a piece of the ordinary dictionary, so that
each is written as a compressed block, and none as a plain one whose length says nothing.

Toxic texts are mostly ordinary prose. What the toxic dictionary is trained on are therefore the stretches of toxic texts that
ordinary ones don't explain: the word sequences of up to ``ORDER`` words that lie in more toxic texts, and there between more different neighbours (so
that copies of one text count once), than chance allows (a binomial tail; the share ``CHANCE`` of them may be false).
Where nothing stands out, it is trained on all segments of toxic text.

The fit uses at most about ``TOXIC_ROWS`` toxic and ``ORDINARY_ROWS`` ordinary labelled rows, and of either class at most ``SAMPLE_BYTES`` of
text, chosen by a hash of the id over all labels; the bounds are parameters. A hash of the text deals the share
``CALIBRATION`` (a parameter) of these rows to the threshold and the calibration and all others to the dictionaries; where that leaves a
part without toxic or without ordinary rows, both use all rows. Scoring covers every window of every text.

Defined cases: null, empty and wordless texts get the score of a text without any saving; if no toxic or no ordinary
row can be learned from, all scores are 0; rows with a null id or label are never learned from, a null id counts as held
out; of several labels of one id the largest holds; repeated rows are scored alike; extra columns are ignored, one named
``score`` gives way to the new one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.llm.common import bucket_of, table

WINDOW, STRIDE = 4, 3
FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 1500, 6000, 16_000_000
DICTIONARY, TOXIC_DICTIONARY = 32768, 8192
ORDER = 2
CHANCE = 0.05
PRIMER = 40
LEVEL, LEAST_MATCH = 3, 6
CALIBRATION = 0.3
_GAPS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_GAPS).split() if text else []


class Model:
    """Both dictionaries, the threshold and the calibration; ``toxic`` empty: nothing was learned."""

    def __init__(self, ordinary: bytes, toxic: bytes, threshold: int = 1, weights=(0.0, 0.0, 0.0, 0.0)):
        self.ordinary, self.toxic, self.threshold, self.weights = ordinary, toxic, threshold, tuple(weights)

    def compressors(self):
        def of(content: bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=128, dict_size=len(content), hash_log=18, chain_log=18, min_match=LEAST_MATCH,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            known.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress

        # The toxic part stands in front, so that all offsets into the ordinary one are the same for both; in three copies at all remainders
        # of 3 (and a multiple of 3 long), as zstd indexes every third place of a dictionary in full.
        copy = self.toxic + b" " * ((1 - len(self.toxic)) % 3)
        return of(self.ordinary), of(3 * copy + self.ordinary)

    def savings(self, text: str | None, compressors) -> np.ndarray:
        words = words_of(text)
        one, two = compressors
        primer, out = self.ordinary[-PRIMER:] + b" ", []
        for i in range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE):
            window = primer + b" ".join(words[i : i + WINDOW]) + b" "
            out.append(len(one(window)) - len(two(window)))
        return np.array(out if words else [0], np.int64)

    def features(self, savings: np.ndarray) -> tuple[float, float, float, float]:
        past = int(savings[savings >= self.threshold].sum())
        return 1.0, float(min(12, max(0, savings.max()))), float(np.log1p(past)), past / len(savings)

    def score(self, text: str | None, compressors) -> float:
        z = float(np.dot(self.weights, self.features(self.savings(text, compressors))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _grams(words: list[bytes], n: int) -> list[bytes]:
    return words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _log_tail(n: int, k: int, p: float) -> float:
    """Chernoff's bound on the log of the chance that k or more of n fall on a side of probability p."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def unusual(toxic: list[list[bytes]], ordinary: list[list[bytes]], order: int = ORDER, chance: float = CHANCE) -> set[bytes]:
    """The word sequences whose share of toxic texts chance doesn't explain; none that holds a shorter one.

    About ``chance`` of what is found may be there by chance (the rule of Benjamini and Hochberg over all sequences of toxic texts).
    """
    out: set[bytes] = set()
    share = len(toxic) / (len(toxic) + len(ordinary))
    for n in range(1, order + 1):
        seen, usual = Counter(), Counter()
        for words in toxic:
            seen.update(set(_grams(words, n)))
        tested = len(seen)
        seen = Counter({g: k for g, k in seen.items() if k > 2 and not out & set(g.split())})
        for words in ordinary:
            usual.update(seen.keys() & set(_grams(words, n)))
        around: dict[bytes, set] = {g: set() for g, k in seen.items() if _log_tail(k + usual[g], k, share) < math.log(chance)}
        for words in toxic:
            for i, g in enumerate(_grams(words, n)):
                if g in around:
                    around[g].add((words[i - 1] if i else b"", words[i + n] if i + n < len(words) else b""))
        found = []
        for g, met in around.items():
            k = min(len(met), seen[g])
            found.append((_log_tail(k + usual[g], k, share), g))
        found.sort()
        passed = [i for i, (tail, _) in enumerate(found, 1) if tail <= math.log(chance * i / tested)]
        out |= {g for _, g in found[: max(passed, default=0)]}
    return out


def stretches(words: list[bytes], marked: set[bytes], order: int = ORDER) -> list[bytes]:
    """The maximal stretches of a text that marked sequences cover, with a blank on both sides."""
    hit = np.zeros(len(words) + 1, bool)
    for n in range(1, order + 1):
        for i, g in enumerate(_grams(words, n)):
            if g in marked:
                hit[i : i + n] = True
    edges = np.flatnonzero(np.diff(np.r_[False, hit].astype(np.int8)))
    return [b" " + b" ".join(words[a:b]) + b" " for a, b in zip(edges[::2], edges[1::2])]


def _segments(texts: list[list[bytes]]) -> list[bytes]:
    return [b" ".join(w[i : i + 24]) for w in texts for i in range(0, len(w), 24)]


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is its own dictionary
        return b" ".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _place(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _dealt(texts: list[str], calibration: float) -> tuple[list[str], list[str]]:
    """The distinct texts for the dictionaries and those for the calibration, by a hash of the text."""
    texts = sorted(set(texts), key=lambda t: (_place(t), t))
    cut = [t for t in texts if _place(t) < calibration * 2.0**64]
    return texts[len(cut) :], cut


def fit(toxic: list[str], ordinary: list[str], calibration: float = CALIBRATION) -> Model:
    """Train both dictionaries, then the threshold and the calibration on rows that the dictionaries haven't seen."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    (toxic, toxic_cut), (ordinary, ordinary_cut) = _dealt(toxic, calibration), _dealt(ordinary, calibration)
    if not (toxic and toxic_cut and ordinary and ordinary_cut):
        toxic = toxic_cut = toxic + toxic_cut
        ordinary = ordinary_cut = ordinary + ordinary_cut
    a, b = [words_of(t) for t in toxic], [words_of(t) for t in ordinary]
    marked = unusual(a, b)
    base = _trained(DICTIONARY, _segments(b), 64, 8)
    extra = _trained(TOXIC_DICTIONARY, [s for w in a for s in stretches(w, marked)] if marked else _segments(a), 12, 6)
    texts, y = toxic_cut + ordinary_cut, np.r_[np.ones(len(toxic_cut)), np.zeros(len(ordinary_cut))]
    model = Model(b" " + base, b" " + extra + b" ")
    pair = model.compressors()
    savings = [model.savings(t, pair) for t in texts]
    best = None
    for threshold in range(1, 8):
        trial = Model(model.ordinary, model.toxic, threshold)
        x = np.array([trial.features(s) for s in savings])
        w = _logistic(x, y)
        loss = float(np.mean(np.log1p(np.exp(-np.clip((2 * y - 1) * (x @ w), -30, 30)))))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w)
    return Model(model.ordinary, model.toxic, best[1], best[2])


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, sample_bytes: int = SAMPLE_BYTES,
    calibration: float = CALIBRATION,
) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect() if r[0] in (0, 1)}
    part = F.when(F.col("y") == 1, toxic_rows / max(1, sizes.get(1, 0))).otherwise(ordinary_rows / max(1, sizes.get(0, 0)))
    chosen = known.filter(F.col("y").isin(0, 1) & (F.pmod(F.xxhash64("id"), F.lit(2**20)) < part * 2.0**20))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "id")  # about toxic_rows + ordinary_rows rows at most
    place = Window.partitionBy("y").orderBy("h", "text")  # two partitions of a bounded sample
    rows = rows.select("y", "text", F.xxhash64("id").alias("h"), F.octet_length("text").alias("n")).withColumn("before", F.sum("n").over(place) - F.col("n"))
    held: dict[int, list[str]] = {0: [], 1: []}
    for r in rows.filter(F.col("before") < sample_bytes).select("y", "text").toLocalIterator():
        held[r["y"]].append(r["text"])
    return fit(held[1], held[0], calibration)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``; all its other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        m = shared.value
        if not m.toxic:
            return pd.Series(0.0, index=texts.index)
        if not made:
            made.append(m.compressors())
        return pd.Series([m.score(t, made[0]) for t in texts], index=texts.index, dtype=float)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"], judge(F.col(text_col).cast("string")).alias("score"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(bucket_of("doc_id", FOLDS) != HELD_OUT))
    held_out = F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    out = score(docs.select("doc_id", held_out, "text"), model).drop("text")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
