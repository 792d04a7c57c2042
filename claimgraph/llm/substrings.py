"""Substring deduplication (operator 7): Rabin-Karp hashes of every 20-word window, counted in Spark.

A word goes if a window that covers it has the word sequence of a window that starts earlier: in a smaller id, or in
the same document at an earlier word. Windows are judged on the input.

Hashing every window is cheap; shuffling every hash is not. So a window is first named by its anchor: the smallest
rolling hash among its 8-word stretches. Equal windows have equal anchors, and neighbouring windows mostly share one,
so about a seventh as many rows are counted. A window whose anchor occurs once can't repeat; all windows of repeated
anchors, and only these, are then hashed over their full length (128 bits) and counted, and each occurrence after the
first is removed. Removed windows merge into maximal intervals. No step lists pairs; counts combine before the
shuffle, and joins on a hot anchor or window are ones that Spark can split.

All windows of a later exact copy start earlier in the first copy, so later copies are settled by a count of text hashes.

Defined cases: null, empty and short texts have no windows and lose nothing; a row with a null id counts as after all
others; the largest long is no id; rows that repeat an id are one document for the order, so a repeated row loses nothing to its twin; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import Stage, table

WINDOW = 20
ANCHOR = 8
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_LAST = 2**63 - 1


class Rolling:
    """Hashes of all stretches of k values, mod 2**64, from prefix sums; equal stretches get equal hashes at any place."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 2**64)
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values)
        if n < k:
            return np.zeros(0, np.uint64)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return (sums[k:] - sums[: n - k + 1]) * self.down[: n - k + 1]


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes a word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), np.uint64).reshape(-1, 2)


def anchor_runs(values: np.ndarray, rolling: Rolling, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each run of windows that share an anchor's place."""
    g = rolling.hashes(values, anchor)
    span = window - anchor + 1
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:] - 1, len(at) - 1]
    return g[at[lo]].view(np.int64), lo.astype(np.int32), hi.astype(np.int32)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False,
) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256; with ``with_text`` also the row's ``text_key`` (its xxhash64) and ``kept``.

    ``kept`` is null where nothing was removed, so that callers keep the original text there.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("ord", F.coalesce("id", F.lit(_LAST))).withColumn("t", F.xxhash64("text"))

    def first_pass(batches):
        rolling = Rolling()
        for pdf in batches:
            out = {k: [] for k in ("n_words", "sha", "md", "g", "lo", "hi")}
            for text in pdf["text"]:
                words = words_of(text)
                g, lo, hi = anchor_runs(word_hashes(words)[:, 0], rolling, window, anchor) if len(words) >= window else ((), (), ())
                joined = b" ".join(words)
                for k, v in zip(out, (len(words), hashlib.sha256(joined).hexdigest(), hashlib.md5(joined).digest(), g, lo, hi)):
                    out[k].append(v)
            yield pd.DataFrame({"ord": pdf["ord"], "t": pdf["t"], **out})

    schema = "ord long, t long, n_words int, sha string, md binary, g array<long>, lo array<int>, hi array<int>"
    anchors_stage = Stage(base.drop("id").mapInPandas(first_pass, schema), "anchors")
    rows = Stage(anchors_stage.df.select("ord", "t", "n_words", "sha", "md"), "rows").df

    # Later exact copies (same words): settled here. Counts are written first, so that the join deals both sides out itself and Spark can split a
    # hot key; so for the anchors and the windows below.
    long_rows = rows.filter(F.col("n_words") >= window)
    firsts = Stage(long_rows.groupBy("md").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts").df
    copies = long_rows.select("ord", "t", "md").join(firsts, "md").filter("ord > first").select("ord", "t").distinct()
    copies = Stage(copies, "copies").df

    anchors = anchors_stage.df.filter(F.col("n_words") >= window).join(copies, ["ord", "t"], "left_anti").selectExpr("ord", "t", "inline(arrays_zip(g, lo, hi))")
    repeated = Stage(anchors.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "repeated").df
    ranges = anchors.join(repeated, "g").groupBy("ord", "t").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    texts = base.filter(F.octet_length("text") >= 2 * window - 1).select("ord", "t", "text")
    suspects = Stage(texts.join(ranges, ["ord", "t"]).dropDuplicates(["ord", "t"]), "suspects").df
    anchors_stage.drop()

    def windows(batches):
        rolling = Rolling()
        for pdf in batches:
            parts = []
            for o, t, text, lo, hi in zip(pdf["ord"], pdf["t"], pdf["text"], pdf["lo"], pdf["hi"]):
                h = word_hashes(words_of(text))
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
                one, two = (rolling.hashes(np.ascontiguousarray(h[:, j]), window)[at].view(np.int64) for j in (0, 1))
                parts.append(pd.DataFrame({"h1": one, "h2": two, "ord": np.int64(o), "t": np.int64(t), "s": at.astype(np.int32)}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["h1", "h2", "ord", "t", "s"])

    hashed = suspects.mapInPandas(windows, "h1 long, h2 long, ord long, t long, s int")
    first = F.min(F.struct("ord", "s")).alias("first")
    seen = Stage(hashed.groupBy("h1", "h2").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n"), "windows").df
    later = hashed.join(seen, ["h1", "h2"]).filter(F.struct("ord", "s") > F.col("first"))
    starts = later.groupBy("ord", "t").agg(F.collect_list("s").alias("starts"))

    def cut(batches):
        for pdf in batches:
            out = {k: [] for k in ("removed", "new_sha", "kept")}
            for text, starts in zip(pdf["text"], pdf["starts"]):
                words = words_of(text)
                gone = covered(np.asarray(starts, np.int64), len(words), window)
                left = [w for w, x in zip(words, gone) if not x]
                for k, v in zip(out, (int(gone.sum()), _digest(left), b" ".join(left).decode("utf-8", "surrogatepass") if with_text else None)):
                    out[k].append(v)
            yield pd.DataFrame({"ord": pdf["ord"], "t": pdf["t"], **out})

    changed = suspects.select("ord", "t", "text").join(starts, ["ord", "t"]).mapInPandas(cut, "ord long, t long, removed int, new_sha string, kept string")
    gone = copies.selectExpr("ord", "t", "-1 AS removed", f"'{_digest([])}' AS new_sha", "'' AS kept")
    out = rows.select("ord", "t", "n_words", "sha").join(changed.unionByName(gone), ["ord", "t"], "left")
    removed = F.when(F.col("removed") < 0, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0)))
    out = out.select(
        F.when(F.col("ord") < _LAST, F.col("ord")).cast(docs.schema[id_col].dataType).alias(id_col), F.col("n_words").cast("long").alias("n_words"), removed.cast("long").alias("n_removed"),
        F.coalesce("new_sha", "sha").alias("kept_sha256"), F.col("t").alias("text_key"), "kept",
    )
    return out if with_text else out.drop("text_key", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut from their texts (kept words joined by one space where any went). Columns as before."""
    cuts = remove_repeats(docs, id_col, text_col, with_text=True).filter("kept IS NOT NULL")
    cuts = cuts.select(F.coalesce(id_col, F.lit(_LAST)).alias("_o"), F.col("text_key").alias("_t"), F.col("kept").alias("_kept")).dropDuplicates(["_o", "_t"])
    keyed = docs.withColumn("_o", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn("_t", F.xxhash64(F.col(text_col).cast("string")))
    return keyed.join(cuts, ["_o", "_t"], "left").withColumn(text_col, F.coalesce("_kept", text_col)).drop("_o", "_t", "_kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS ord,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
o AS (
  SELECT r, ord, s, hash(array_to_string(ws[s:s + 19], ' ')) AS h, md5(array_to_string(ws[s:s + 19], ' ')) AS m
  FROM (SELECT r, ord, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
f AS (SELECT r, s, (ord, s) > min((ord, s)) OVER (PARTITION BY h, m) AS later FROM o),
x AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS k FROM f WHERE later),
g AS (SELECT r, list(k) AS ks FROM x GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(CAST(len(g.ks) AS BIGINT), 0) AS n_removed,
  sha256(CASE WHEN g.ks IS NULL THEN array_to_string(w.ws, ' ') ELSE coalesce(array_to_string(
    list_transform(list_filter(range(1, len(w.ws) + 1), lambda k: NOT list_contains(g.ks, k)), lambda k: w.ws[k]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""
