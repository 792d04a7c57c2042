"""Katz backoff language model (operator 9): Good-Turing discounted n-grams over unigrams, exactly normalised.

Counts come from all training texts. Texts are dealt into chunks by a hash of the id; a chunk sends each of its distinct n-grams of every
order once, packed with its count, to the partition that owns the key's hash range. That partition holds the
total counts and answers each chunk in the order asked. Backoff weights are gathered the same way, one order after the other: a chunk adds
up, for each context, the discounted mass and the lower order's mass of the n-grams it saw (an n-gram's share in proportion to
the chunk's part of its count), and the owner of the context sums them and answers with the weight. So a common word
costs a partition one entry a chunk, no table is broadcast, and what reaches the driver is a few numbers a partition.

With h the last ``order - 1`` words (a text's beginning fills up what is missing) and h' without its first: P(w | h) = c*(h, w) / c(h) where the n-gram
was seen, else a(h) P(w | h'), or P(w | h') where the context was not seen; P(w) =
c*(w) / N, and what the discounts free is the probability of any unknown word. The order is a parameter, ``ORDER`` by default. Counts over 5 aren't discounted; where
Good-Turing's discount isn't between 0 and 1, half a count is taken off. If nothing is freed (no small counts), half a
count is added to the denominator and set aside, so that every distribution sums to 1 over known words and the unknown word.

Keys are 64-bit hashes of words and of longer n-grams.

Defined cases: null, empty and blank texts are the end token alone; repeated rows count and score once each; a null id
is learned from by nobody and counts as held out; with nothing to learn from every token has probability 1 in the model and N and V are 0;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import Stage, bucket_of, table

FOLDS, HELD_OUT = 10, 0
LARGEST = 5
CHUNK_BYTES = 4_000_000
KEYS_A_BUCKET = 2_000_000
ORDER = 2
_END, _BEGIN = np.uint64(0x1D8AF066F2D6B1F5), np.uint64(0x7A3C5B9E1F204D68)
_CONTEXTS = 100  # kinds of rows: n for n-grams, _CONTEXTS + n for contexts of n words


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Grams:
    """The distinct n-grams of a chunk in the order of their keys, and for each token the one that ends there."""

    def __init__(self, keys: np.ndarray, learn: np.ndarray, last: np.ndarray):
        self.keys, first, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = np.bincount(self.of[learn], minlength=len(self.keys))
        self.first, self.ends = first, last[first]


class Chunk:
    """The tokens of some texts, and their distinct n-grams of each order."""

    def __init__(self, texts, train, order: int = ORDER):
        digest, parts, lens = xxhash.xxh3_64_digest, [], []
        end = _END.tobytes()
        for text in texts:
            words = words_of(text)
            parts += [digest(w) for w in words]
            parts.append(end)
            lens.append(len(words) + 1)
        w = np.frombuffer(b"".join(parts), np.uint64)
        self.lens = np.array(lens, np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        learn = np.repeat(np.asarray(train, bool), self.lens)
        self.grams, self.contexts, key, begin = [Grams(w, learn, w == _END)], [], w, _BEGIN
        for _ in range(1, order):
            before, below = np.empty_like(w), self.grams[-1]
            before[1:] = key[:-1]
            before[self.starts] = begin
            key = _pair_keys(before, w)
            #: a token's context: a place among the n-grams of one word less, or one past them where a text begins
            context = np.empty(len(w), np.int64)
            context[1:] = below.of[:-1]
            context[self.starts] = len(below.keys)
            g = Grams(key, learn, w == _END)
            g.suffix, g.context = below.of[g.first], context[g.first]
            self.contexts.append((begin, below))
            self.grams.append(g)
            begin = _pair_keys(np.array([begin]), np.array([_BEGIN]))[0]

    def context_keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all contexts of ``n`` words in order, and the place of each n-gram and of the beginning among them."""
        begin, below = self.contexts[n - 1]
        keys = np.r_[below.keys, begin]
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], place

    def context_counts(self, n: int, totals: list[np.ndarray]) -> np.ndarray:
        """How often the contexts of ``n`` words are followed by a token. What ends a text is no context; every training text has one beginning and one end."""
        begins = totals[0][int(np.searchsorted(self.grams[0].keys, _END))]
        return np.r_[np.where(self.grams[n - 1].ends, 0, totals[n - 1]), begins].astype(np.float64)


def _slices(keys: np.ndarray, buckets: int):
    """(bucket, from, to) of sorted keys; a bucket is a range of hashes."""
    if buckets == 1:
        edges = np.array([0, len(keys)])
    else:
        bits = buckets.bit_length() - 1
        edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
    return [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b + 1] > edges[b]]


class Discounts:
    """Discounted counts of each order from their counts of counts, and the unigram distribution."""

    def __init__(self, stats: list):
        words = stats[0]
        self.total, self.types = int(words[LARGEST + 1]), int(words[LARGEST + 2])
        self.factors = [self._factors(x[: LARGEST + 1]) for x in stats]
        freed = sum(r * words[r - 1] * (1 - self.factors[0][r]) for r in range(1, LARGEST + 1))
        self.unknown = float(freed) if freed > 1e-9 else 0.5
        self.mass = float(self.total if freed > 1e-9 else self.total + 0.5)

    @staticmethod
    def _factors(n) -> np.ndarray:
        out = np.ones(LARGEST + 2)
        n = [0.0, *map(float, n)]  # n[r]: how many have count r
        cut = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
        for r in range(1, LARGEST + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def of(self, n: int, counts: np.ndarray) -> np.ndarray:
        return counts * self.factors[n - 1][np.minimum(counts, LARGEST + 1)]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.of(1, counts), self.unknown) / self.mass

    def chances(self, c: Chunk, totals: list[np.ndarray], weights: list[tuple], n: int) -> np.ndarray:
        """log10 P of each n-gram's last word after its others: seen ones from their count, all others by way of the next shorter one."""
        if n == 1:
            return np.log10(self.unigram(totals[0]))
        g, total = c.grams[n - 1], totals[n - 1]
        weight, bare = weights[n - 2]
        below = np.maximum(c.context_counts(n - 1, totals) + 0.5 * bare, 1e-300)
        seen = np.log10(np.maximum(self.of(n, total), 1e-300)) - np.log10(below)[g.context]
        return np.where(total > 0, seen, weight[g.context] + self.chances(c, totals, weights, n - 1)[g.suffix])


def _weights(seen_mass, freed, counts) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: log10 of the backoff weight, and the denominator of seen pairs. Contexts that never occurred back off with 1."""
    bare = freed <= 1e-9
    below = np.where(bare, counts + 0.5, counts)
    share = np.where(bare, 0.5, freed) / np.maximum(below, 1e-300)
    weight = np.log10(share / np.maximum(1 - seen_mass, 1e-12))
    return np.where(counts > 0, weight, 0.0), below


_ASK = "kind int, bucket int, chunk long, keys binary, a binary, b binary, c binary"
_TELL = "kind int, bucket int, chunk long, a binary, b binary, stats array<double>"


def _ask(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "keys", "a", "b", "c"])


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES, keys_a_bucket: int = KEYS_A_BUCKET,
) -> DataFrame:
    """Per row: id, held_out (not ``train``), n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    chunks = max(1, ((size[0] or 0) + size[1]) // chunk_bytes)
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, (size[0] or 0) / 6 / keys_a_bucket)))))
    buckets_of = lambda n: max(1, buckets // 4) if n == 1 else buckets
    orders = range(1, order + 1)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.substring("text", 1, 64)), F.lit(chunks)))

    def ask_counts(key, pdf):
        c, out = Chunk(pdf["text"], pdf["train"], order), []
        for n, g in zip(orders, c.grams):
            for b, i, j in _slices(g.keys, buckets_of(n)):
                out.append((n, b, key[0], g.keys[i:j].tobytes(), g.counts[i:j].astype("<u4").tobytes(), None, None))
        return _ask(out)

    def tell_counts(key, pdf):
        what, bucket = int(key[0]), int(key[1])
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        known, where = np.unique(keys, return_inverse=True)
        totals = np.bincount(where, np.frombuffer(b"".join(pdf["a"]), "<u4")).astype(np.int64)
        counts = totals[totals > 0]
        stats = [float((counts == r).sum()) for r in range(1, LARGEST + 2)] + [float(counts.sum()), float(len(counts))]
        out, at = [(what, bucket, -1, b"", b"", stats)], 0
        for chunk, k in zip(pdf["chunk"], pdf["keys"]):
            n = len(k) // 8
            out.append((what, bucket, chunk, totals[where[at : at + n]].astype("<u8").tobytes(), b"", None))
            at += n
        return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "a", "b", "stats"])

    asked = rows.groupBy("chunk").applyInPandas(ask_counts, _ASK)
    told = Stage(asked.groupBy("kind", "bucket").applyInPandas(tell_counts, _TELL), "counts").df
    sums = {r["kind"]: np.array(r["s"]) for r in told.filter("chunk = -1").groupBy("kind").agg(
        F.array(*[F.sum(F.col("stats")[i]) for i in range(LARGEST + 3)]).alias("s")).collect()}
    model = Discounts([sums.get(n, np.zeros(LARGEST + 3)) for n in orders])
    counts = told.filter("chunk >= 0").select("kind", "bucket", "chunk", "a", "b")

    def read(pdf, kind: int, column: str, dtype) -> np.ndarray:
        mine = pdf[pdf["kind"] == kind].sort_values("bucket")
        return np.frombuffer(b"".join(mine[column]), dtype)

    def answers(c: Chunk, pdf, upto: int) -> tuple[list, list]:
        """Total counts of all orders, and the weights of contexts of fewer than ``upto`` words, in the order of ``Chunk``."""
        totals = [read(pdf, n, "a", "<u8").astype(np.int64) for n in orders]
        places = [c.context_keys(n)[1] for n in range(1, upto)]
        return totals, [(read(pdf, _CONTEXTS + n, "a", "<f8")[p], read(pdf, _CONTEXTS + n, "b", "u1")[p]) for n, p in enumerate(places, 1)]

    def ask_weights(n: int):
        """For contexts of ``n`` words: what the chunk's learned n-grams of one word more take from, and leave to, the lower order."""

        def ask(key, pdf, answer):
            c = Chunk(pdf["text"], pdf["train"], order)
            totals, weights = answers(c, answer, n)
            g = c.grams[n]
            learned = g.counts > 0
            share, total, where = (g.counts / np.maximum(totals[n], 1))[learned], totals[n][learned], g.context[learned]
            lower = 10 ** model.chances(c, totals, weights, n)
            size = len(c.grams[n - 1].keys) + 1
            seen = np.bincount(where, share * lower[g.suffix[learned]], size)
            freed = np.bincount(where, share * (total - model.of(n + 1, total)), size)
            keys, place = c.context_keys(n)
            back = np.argsort(place)
            seen, freed, have = (x[back].astype("<f8") for x in (seen, freed, c.context_counts(n, totals)))
            return _ask([(_CONTEXTS + n, b, key[0], *(x[i:j].tobytes() for x in (keys, seen, freed, have))) for b, i, j in _slices(keys, buckets_of(n))])

        return ask

    def tell_weights(key, pdf):
        pdf = pdf.sort_values("chunk")
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        known, where = np.unique(keys, return_inverse=True)
        seen, freed = (np.bincount(where, np.frombuffer(b"".join(pdf[x]), "<f8")) for x in "ab")
        have = np.zeros(len(known))
        have[where] = np.frombuffer(b"".join(pdf["c"]), "<f8")
        weight, below = (x[where].astype("<f8") for x in _weights(seen, freed, have))
        ends = np.cumsum([len(k) // 8 for k in pdf["keys"]])
        cut = [slice(e - len(k) // 8, e) for e, k in zip(ends, pdf["keys"])]
        return pd.DataFrame({
            "kind": int(key[0]), "bucket": int(key[1]), "chunk": pdf["chunk"].to_numpy(),
            "a": [weight[s].tobytes() for s in cut], "b": [(below[s] != np.floor(below[s])).astype("u1").tobytes() for s in cut], "stats": None,
        })

    known = counts
    for n in range(1, order):
        asked = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(ask_weights(n), _ASK)
        known = known.unionByName(Stage(asked.groupBy("kind", "bucket").applyInPandas(tell_weights, _TELL), "weights").df.drop("stats"))

    def judge(key, pdf, answer):
        c = Chunk(pdf["text"], pdf["train"], order)
        totals, weights = answers(c, answer, order)
        words, word = totals[0], c.grams[0].of
        token = model.chances(c, totals, weights, order)[c.grams[-1].of]
        base = np.log10((words + 0.1) / (model.total + 0.1 * (model.types + 1)))[word]
        add = lambda x: np.add.reduceat(x, c.starts)
        return pd.DataFrame({
            "id": pdf["id"], "held_out": ~pdf["train"].to_numpy(bool), "n_tokens": c.lens, "n_known": add((words > 0)[word].astype(np.int64)),
            "train_tokens": model.total, "base_score": add(base), "score": add(token),
        })

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(judge, schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), bucket_of("doc_id", FOLDS) != HELD_OUT)
