"""Order MinHash near-duplicate detection (operator 10).

A text is its sequence of five-word shingles (lower-cased words between white space; shorter texts are one shingle).
Shingles carry their occurrence number. Each of ``FUNCTIONS`` hash functions samples the ``KEPT`` smallest labelled
shingles and keeps them in text order, so two texts agree on a function if they share these shingles and their order.
Texts that agree on a function share a bucket; at similarity 0.8 a pair shares one with probability over 0.9999. First all texts of a bucket are
compared with its leader, the text that meets most others. What that leaves in more than one component in some bucket is settled exactly, without listing the
pairs of a bucket: a prefix filter over all shingles of these texts. Shingles are ordered by how many of these texts hold them, the rarest
first; two texts that can reach the similarity share a shingle that stands, in both, before the place from which on too few shingles are left.
Only pairs that share one there, and lie in two components, are candidates. A candidate is verified by banded alignment of both
shingle sequences: a link needs m / (n1 + n2 - m) >= 0.8 with m the shingles aligned in order. Classes are the connected components of the links.

Exact copies are settled before by a count of text hashes and take part once.

Defined cases: null, empty and wordless texts are alone in their class; repeated rows (also rows that share an id)
share a class; a null id gets a place in its class and no say in its name; the largest 2**40 longs are no ids; an empty table gives no rows; extra
columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.llm.common import Stage, table
from claimgraph.llm.components import components
from claimgraph.llm.substrings import Rolling

SHINGLE = 5
SIMILARITY = 0.8
FUNCTIONS = 16
KEPT = 3
AT_ONCE = 512
_LAST = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def shingles(words: list[bytes], rolling: Rolling, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each k consecutive words, or for all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_digest
    values = np.frombuffer(b"".join([digest(w) for w in words]), np.uint64)
    return _mix(rolling.hashes(values, min(k, len(values))) + np.uint64(min(k, len(values))))


def labelled(x: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence apart."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    at = np.arange(len(s))
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return x
    nth = np.empty(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(nth == 0, x, _mix(x + nth * np.uint64(0x9E3779B97F4A7C15)))


def sketch(x: np.ndarray, functions: int = FUNCTIONS, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Per hash function: a hash of its smallest labelled shingles in text order; and all of these shingles."""
    x = labelled(x)
    kept = min(kept, len(x))
    if kept < len(x):
        step = max(1, 1_000_000 // len(x))  # a very long text goes by a few functions at once
        at = np.concatenate([np.argpartition(x[None, :] * _SEEDS[i : min(i + step, functions), None], kept - 1, axis=1)[:, :kept] for i in range(0, functions, step)])
    else:
        at = np.tile(np.arange(len(x)), (functions, 1))
    chosen = x[np.sort(at, axis=1)]
    out = np.full(functions, kept, np.uint64)
    for j in range(kept):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
    marks = _mix(chosen + np.arange(1, functions + 1, dtype=np.uint64)[:, None]).astype(np.uint32).view(np.int32)
    return _mix(out + np.arange(functions, dtype=np.uint64)).view(np.int64), marks.ravel()


def aligned(x: np.ndarray, y: np.ndarray, need: int) -> int:
    """Most elements of x and y that align in order, inside the band that ``need`` of them leave; 0 if fewer are possible.

    The band: with ``need`` pairs aligned at most len(x) - need and len(y) - need elements stay alone, so x[i] can only
    meet y[j] for -(len(y) - need) <= i - j <= len(x) - need. One row of the table is one integer, a bit for each i.
    """
    n1, n2 = len(x), len(y)
    if min(n1, n2) < need:
        return 0
    m = min(n1, n2)
    differ = np.flatnonzero(x[:m] != y[:m])
    head = int(differ[0]) if len(differ) else m
    x, y, m = x[head:], y[head:], m - head
    differ = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
    tail = int(differ[0]) if len(differ) else m
    x, y = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    below, above = n2 - need, n1 - need
    places: dict[int, list[int]] = {}
    for i, v in enumerate(x):
        places.setdefault(v, []).append(i)
    full = (1 << len(x)) - 1
    row = full
    for j, v in enumerate(y):
        mask = 0
        for i in places.get(v, ()):
            if j - below <= i <= j + above:
                mask |= 1 << i
        if mask:
            u = row & mask
            row = ((row + u) | (row - u)) & full
    return head + tail + len(x) - row.bit_count()


def needed(n1: int, n2: int, similarity: float = SIMILARITY) -> int:
    return int(np.ceil(similarity * (n1 + n2) / (1 + similarity) - 1e-9))


def _sketches(base: DataFrame) -> DataFrame:
    def run(batches):
        rolling = Rolling()
        for pdf in batches:
            out = {k: [] for k in ("k1", "k2", "n", "omh", "marks")}
            for text in pdf["text"]:
                words = words_of(text)
                x = shingles(words, rolling)
                omh, marks = sketch(x) if len(x) else ((), ())
                key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                for k, v in zip(out, (key[0], key[1], len(x), omh, marks)):
                    out[k].append(v)
            yield pd.DataFrame({"ord": pdf["ord"], **out})

    return base.drop("id").mapInPandas(run, "ord long, k1 long, k2 long, n int, omh array<long>, marks array<int>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts align."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        rolling = Rolling()
        for pdf in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                if len(known) > AT_ONCE:  # the rows come sorted by one side, so what is read again is near
                    known.clear()
                x, y = (known[n] if n in known else known.setdefault(n, shingles(words_of(t), rolling)) for n, t in ((a, ta), (b, tb)))
                need = needed(len(x), len(y), similarity)
                keep.append(aligned(x, y, need) >= need)
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _with_leader(members: DataFrame) -> DataFrame:
    """(key, node, leader) of the members besides the leader: the member that meets most others, then the smallest."""
    leaders = Stage(members.groupBy("key").agg(F.min(F.struct(-F.col("score"), "node")).alias("l")), "leaders").df
    return members.join(leaders.select("key", F.col("l.node").alias("leader")), "key").filter("node <> leader").select("key", "node", "leader")


def _likely(led: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) whose sizes and sampled shingles leave the similarity possible (five standard deviations).

    What that wrongly leaves out shares a bucket in two components, and so is met again by the exact step.
    """
    pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(marks.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("marks").alias(f"m{side}")), side)
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    shared = F.size(F.array_intersect("ma", "mb")) / F.greatest(F.size(F.array_distinct("ma")), F.lit(1))
    return pairs.filter((small >= similarity * large) & (shared >= similarity - 0.32)).select("a", "b")


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, comp) of the texts that share a bucket with a text of another component."""
    placed = members.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    return placed.join(Stage(mixed, "mixed").df, "key").select("node", "comp").distinct()


def _prefix_pairs(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of the texts ``open_`` (node, comp) in two components that share a shingle early enough to reach the similarity.

    With i (j) shingles of a text of n (m) before their first common one in the common order, at most the least of n - i and m - j are common.
    """

    def marked(batches):
        rolling = Rolling()
        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                pdf = whole.iloc[at : at + AT_ONCE]
                x = [labelled(shingles(words_of(t), rolling)).view(np.int64) for t in pdf["text"]]
                yield pd.DataFrame({"node": pdf["node"], "comp": pdf["comp"], "n": [len(v) for v in x], "x": x})

    sets = Stage(texts.join(open_, "node").mapInPandas(marked, "node long, comp long, n int, x array<long>"), "sets").df
    each = sets.select("node", "comp", "n", F.explode("x").alias("x"))
    often = Stage(each.groupBy("x").agg(F.count("*").alias("f")).filter("f > 1"), "often").df
    by = Window.partitionBy("node")
    shared = each.join(often, "x").withColumn("r", F.row_number().over(by.orderBy("f", "x"))).withColumn("c", F.count("*").over(by))
    place = F.col("n") - F.col("c") + F.col("r") - 1  # shingles that no other text holds come first
    early = shared.withColumn("i", place.cast("int")).filter(F.col("i") <= F.col("n") - F.ceil(similarity * F.col("n") - F.lit(1e-9)))
    early = Stage(early.select("x", "node", "comp", "n", "i"), "early").df
    parts = early.groupBy("x", "comp").agg(F.count("*").alias("c")).groupBy("x")
    parts = parts.agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    early = Stage(early.join(Stage(parts, "parts").df, "x"), "early").df
    few = early.filter("comp <> most").drop("most")  # every pair of two components has a text outside the shingle's largest one
    every = early.select("x", F.col("node").alias("other"), F.col("comp").alias("there"), F.col("n").alias("m"), F.col("i").alias("j"), (F.col("comp") == F.col("most")).alias("large"))
    need = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("m")) - F.lit(1e-9))
    fits = (F.col("i") <= F.col("n") - need) & (F.col("j") <= F.col("m") - need) & (F.col("comp") != F.col("there")) & (F.col("large") | (F.col("node") < F.col("other")))
    pairs = few.join(every, "x").filter(fits)
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) once ``links`` (a, b) join the components ``comps`` too: only links between components are followed again."""
    for side in "ab":
        links = links.join(comps.select(F.col("node").alias(side), F.col("comp").alias("c")), side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    more = Stage(components(links), "components").df
    alone = more.join(comps, "node", "left_anti")
    moved = comps.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp", "left").select("node", F.coalesce("c", "comp").alias("comp"))
    return Stage(moved.unionByName(alone), "components").df


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: its id and ``class_id``, the smallest id of its class (the row's own id if it is alone)."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    unnamed = F.lit(_LAST) - F.pmod(F.xxhash64("text"), F.lit(2**40))
    base = base.withColumn("ord", F.coalesce("id", unnamed))
    rows = Stage(_sketches(base), "sketches").df

    # Written first, so that the joins deal both sides out themselves and Spark can split a large group of copies; so everywhere below.
    same = Stage(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("ord").alias("node")), "same").df
    own = rows.join(same.withColumnRenamed("node", "ord"), ["k1", "k2", "ord"], "left_semi")
    reps = Stage(own.dropDuplicates(["ord"]).select(F.col("ord").alias("node"), "n", "marks", "omh"), "texts").df

    keys = reps.select("node", F.explode("omh").alias("key"))
    sizes = Stage(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes").df
    shared = Stage(keys.join(sizes, "key"), "buckets").df
    scores = Stage(shared.groupBy("node").agg(F.sum("size").alias("score")), "scores").df
    members = Stage(shared.drop("size").join(scores, "node"), "members").df
    texts = Stage(base.select(F.col("ord").alias("node"), "text").join(scores.select("node"), "node").dropDuplicates(["node"]), "texts").df
    marks = reps.select("node", "n", "marks").join(scores.select("node"), "node")

    links = Stage(_verified(Stage(_likely(_with_leader(members), marks, similarity), "likely").df, texts, similarity), "links").df
    comps = Stage(components(links), "components").df
    pairs = Stage(_prefix_pairs(Stage(_unsettled(members, comps), "open").df, texts, similarity), "pairs").df
    comps = _joined(comps, _verified(pairs, texts, similarity))

    named = rows.join(same.withColumnRenamed("node", "rep"), ["k1", "k2"], "left").withColumn("node", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("ord")))
    named = named.select("ord", "node").join(comps, "node", "left").withColumn("class_id", F.coalesce("comp", "node"))
    known = lambda c: F.when(F.col(c) <= F.lit(_LAST - 2**40), F.col(c))
    return named.select(known("ord").cast(docs.schema[id_col].dataType).alias(id_col), known("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each class; rows without an id can't be told apart and stay. Columns as before."""
    found = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    named = docs.join(found, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
