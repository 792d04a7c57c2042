"""Best-fit packing with swap-based local search (operator 8).

Every document becomes token ids plus an end id; only documents longer than a sequence are cut, into full pieces
with the shorter one first. A full piece is a sequence. The other lengths lie in 1..capacity-1, so how many pieces have each length (fewer than
``capacity`` numbers, whatever the input) is all that a packing plan needs. The driver packs that histogram: best-fit decreasing in
bulk over classes of bins with equal contents, then local search that moves a piece, or exchanges one for one or two
for one, between underfull bins while the sum of squared fills grows, until bins empty or the lower bound is met; where nothing gains,
exchanges of equal lengths, with full bins too, change what underfull bins hold, until something gains.
Executors then give the r-th piece of each length the r-th slot of that length. No task sees more than a salted share
of one length, and nothing that grows with the documents reaches the driver: a plan's size is bounded by the lengths, as a step splits one class at most.

Defined cases: a null or empty text is a one-token document (the end id); repeated rows are packed once each; a null
id is kept; an empty table gives no rows; extra columns are ignored; very long texts are cut whole.
"""

from __future__ import annotations

import base64
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.llm.common import Stage, table

CAPACITY = 1024
END_ID = 2
ROWS_A_SALT = 500
PATIENCE = 4000


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> uint32 ids exactly as the tokenizers file gives them.

    The ranks file holds the same vocabulary and is several times faster; texts that hold a special token's string,
    which the tokenizers file reads as that token, go through the tokenizers file itself.
    """
    import public_tokenizers
    import tiktoken

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> np.ndarray:
        if "<|" not in text:
            return np.asarray(fast.encode_ordinary(text), np.uint32)
        if not slow:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` tokens: full pieces, a shorter one first where they don't divide it."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(capacity, (first or capacity) if s == 0 else capacity)) for s in starts]


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, json_path, ranks_path) -> DataFrame:
    made: list = []

    def run(batches):
        if not made:
            made.append(encoder(json_path, ranks_path))
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                ids = np.append(made[0](text or ""), np.uint32(end_id)).astype("<u4")
                for p, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((key, p, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "id string, piece int, start long, length long, ids_crc32 long")


# A plan: {sorted tuple of lengths: number of bins that hold exactly these}.


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing: each piece goes to the fullest bin that takes it; equal steps are done at once."""
    open_bins: dict[int, list[list]] = {}  # by what is left
    plan: Counter = Counter()

    def put(left: int, items: tuple, n: int) -> None:
        if left and n:
            open_bins.setdefault(left, []).append([items, n])
        elif n:
            plan[items] += n

    for length in sorted(histogram, reverse=True):
        c = histogram[length]
        while c:
            left = min((r for r in open_bins if r >= length), default=0)
            if left:
                items, k = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left]
            else:
                left, items, k = capacity, (), c
            each = left // length
            whole = min(k, c // each)
            put(left - each * length, items + (length,) * each, whole)
            c -= whole * each
            k -= whole
            if c and k and c < each:
                put(left - c * length, items + (length,) * c, 1)
                c, k = 0, k - 1
            if items:
                put(left, items, k)
    for left, classes in open_bins.items():
        for items, k in classes:
            plan[items] += k
    return plan


def _without(items: tuple, gone: tuple, more: tuple) -> tuple:
    out = list(items)
    for x in gone:
        out.remove(x)
    return tuple(sorted(out + list(more)))


def _choices(items: tuple) -> dict[int, tuple]:
    """What can leave a bin at once, by its length: one piece or two."""
    out = {items[i] + y: (items[i], y) for i in range(len(items)) for y in items[i + 1 :]}
    return out | {x: (x,) for x in items}


class _Search:
    """The classes of bins of a plan (bins with equal contents) and what can leave them."""

    def __init__(self, plan: Counter, capacity: int):
        self.capacity, self.bins, self.choices = capacity, Counter(), {}
        #: By length: what holds a piece, or two pieces, of it. Classes that are gone stay listed and are passed over.
        self.holding: dict[int, list[tuple[tuple, tuple]]] = {}
        #: The underfull classes and, a row for each choice of theirs, its length, its class's fill and its class's place.
        self.under: list[tuple] = []
        self.rows: np.ndarray | None = None
        for items, k in plan.items():
            self.add(tuple(sorted(items)), k)

    def add(self, items: tuple, k: int) -> None:
        if not items:
            return
        if (self.bins[items] == 0 or self.bins[items] + k == 0) and sum(items) < self.capacity:
            self.rows = None
        self.bins[items] += k
        if items not in self.choices:
            self.choices[items] = _choices(items)
            for length, ys in self.choices[items].items():
                self.holding.setdefault(length, []).append((items, ys))
        if not self.bins[items]:
            del self.bins[items]

    def _read(self) -> None:
        if self.rows is None:
            self.under = sorted((i for i in self.bins if sum(i) < self.capacity), key=lambda i: (sum(i), i))
            parts = [(v, sum(i), j) for j, i in enumerate(self.under) for v in (0, *self.choices[i])]
            self.rows = np.array(parts, np.int64).reshape(-1, 3).T

    def best(self, a: tuple):
        """The move or exchange of a with another underfull bin that lets the squared fill grow most: (emptier, fuller, out, back), or None."""
        self._read()
        length, fill, place = self.rows
        fa, found = sum(a), (0,)
        alone = self.bins[a] < 2
        for out in (0, *self.choices[a]):
            d = out - length  # what the other bin gains
            gain = d * (fill - fa + d)
            fits = (d <= self.capacity - fill) & (-d <= self.capacity - fa) & (gain > 0)
            k = int(np.where(fits, gain, 0).argmax())
            if alone and fits[k] and self.under[place[k]] == a:
                fits &= place != place[k]
                k = int(np.where(fits, gain, 0).argmax())
            if fits[k] and gain[k] > found[0]:
                found = (int(gain[k]), out, int(length[k]), self.under[place[k]])
        if len(found) == 1:
            return None
        _, out, back, b = found
        return a, b, self.choices[a][out] if out else (), self.choices[b][back] if back else ()

    def exchange(self, a: tuple, b: tuple, xs: tuple, ys: tuple, m: int) -> tuple[tuple, tuple]:
        """Do it in ``m`` pairs of bins; what became of both."""
        new = _without(a, xs, ys), _without(b, ys, xs)
        for items, k in ((a, -m), (b, -m), (new[0], m), (new[1], m)):
            self.add(items, k)
        return new

    def level(self, rng: random.Random):
        """An exchange of equal lengths, not one for one, of an underfull bin chosen by chance with any bin: (a, b, out, back), or None."""
        self._read()
        a = rng.choice(self.under)
        length, xs = rng.choice(list(self.choices[a].items()))
        there = self.holding.get(length, ())
        for _ in range(min(8, len(there))):
            b, ys = there[rng.randrange(len(there))]
            if self.bins.get(b, 0) > (a == b) and ys != xs:
                return a, b, xs, ys
        return None


def improve(plan: Counter, capacity: int, patience: int = PATIENCE) -> Counter:
    """Local search: moves and exchanges between underfull bins while the squared fill grows and bins empty.

    Where nothing gains, exchanges of equal lengths (two for one or two for two, also with full bins) change at no loss what underfull bins
    hold, until one of them gains. The search ends at the lower bound, or after ``patience`` such steps in a row without a gain: a
    parameter of the search, not of what is packed.
    """
    state, rng = _Search(plan, capacity), random.Random(5)
    bound = -(-sum(sum(i) * k for i, k in state.bins.items()) // capacity)
    todo, idle = [i for i in sorted(state.bins, key=lambda i: (-sum(i), i)) if sum(i) < capacity], 0
    while state.bins.total() > bound and idle < patience:
        while todo:
            a = todo.pop()
            if not state.bins.get(a) or sum(a) >= capacity:
                continue
            found = state.best(a)
            if found:
                a, b, xs, ys = found
                todo += [a, b, *state.exchange(a, b, xs, ys, state.bins[a] // 2 if a == b else min(state.bins[a], state.bins[b]))]
                idle = 0
        idle += 1
        flat = state.level(rng)
        if flat:
            todo += state.exchange(*flat, 1)
    return state.bins


def slots_of(plan: Counter) -> pd.DataFrame:
    """Where the pieces of each length go: ranks from ``lo`` on are dealt over ``bins`` bins from ``seq`` on, at ``offset``."""
    rows, seq, used = [], 0, Counter()
    for items, k in sorted(plan.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(items).items(), reverse=True):
            rows.append((length, used[length], k, seq, offset))
            used[length] += k * each
            offset += length * each
        seq += k
    return pd.DataFrame(rows, columns=["length", "lo", "bins", "seq", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    json_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = pieces_of(docs, id_col, text_col, capacity, end_id, json_path, ranks_path)
    # A hundredth of the input: one file a core at most, not one a split of the input; Spark splits those beyond its advisory size.
    pieces = Stage(pieces.hint("rebalance", spark.sparkContext.defaultParallelism), "pieces").df
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    full, shorter = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    # A full piece is a sequence of its own. The pieces are a written table, so that a task that runs again numbers them alike.
    whole = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    histogram.pop(capacity, None)
    plan = improve(best_fit(histogram, capacity), capacity)
    slots = spark.sparkContext.broadcast({c: v.to_numpy() for c, v in slots_of(plan).items()})
    shares = spark.createDataFrame([(n, max(1, k // ROWS_A_SALT)) for n, k in histogram.items()], "length long, salts long")  # fewer than `capacity` rows
    salted = shorter.join(F.broadcast(shares), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), "salts")).drop("salts")
    before = salted.groupBy("length", "salt").count()
    before = before.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local"))

    def place(batches):
        s = slots.value
        keys = s["length"].astype(np.int64) << 44 | s["lo"].astype(np.int64) if len(s["length"]) else None
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            r = rank - s["lo"][at]
            yield pdf.drop(columns="rank").assign(sequence_id=s["seq"][at] + r % s["bins"][at], offset=s["offset"][at] + r // s["bins"][at] * length)

    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    out = ranked.mapInPandas(place, "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    out = out.unionByName(whole)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
