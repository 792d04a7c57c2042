"""Benchmark decontamination (operator 5): one Aho-Corasick automaton over normalised test items.

Text is normalised byte by byte: A-Z become a-z, other ASCII outside 0-9a-z becomes a gap, every byte of a non-ASCII
character belongs to a word. The automaton holds each distinct window of ten item words (or the whole item where it
is shorter) with a gap on both sides, so a hit always covers whole words. Each text is scanned once; hits map back
to word numbers and to character offsets of the original.

Items are shared with the executors as one automaton while their text stays within ``block_bytes``; beyond that they
are dealt into blocks of that size by a hash of the item id and the rows stream through one automaton per block.

Defined cases: null or wordless texts have no words and no hits; null or wordless items match nothing; repeated items
count once per distinct id; repeated documents are separate rows; an empty benchmark hits nothing; a null item id is
never reported but its windows still mark words. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import table

WINDOW = 10
BLOCK_BYTES = 32_000_000
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    """The byte patterns of an item, with a gap on both sides."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str | None, str | None]], window: int = WINDOW):
    """The automaton over (item id, text) pairs: a pattern's value is its number of words and its items. None if there are no patterns."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            owners.setdefault(pattern, set()).update(() if item is None else (item,))
    if not owners:
        return None
    trie = ahocorasick.Automaton()
    for pattern, who in owners.items():
        trie.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, tuple(who)))
    trie.make_automaton()
    return trie


def scan(trie, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words any pattern covers, and the items that occur."""
    hit, found = np.zeros(len(words) + 1, np.int64), set()
    if trie is not None and words:
        text, ends = (b" " + b" ".join(words) + b" ").decode("latin-1"), None
        for at, (n, who) in trie.iter(text):
            if ends is None:
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, at))  # the word before the closing gap
            hit[last - n + 1] += 1
            hit[last + 1] -= 1
            found.update(who)
    return np.cumsum(hit[:-1]) > 0, found


def spans_of(text: str, covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as character offsets of the original text."""
    spans: list[tuple[int, int]] = []
    before = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if covered[k]:
            if before == k - 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            before = k
    return spans


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document row: its id, n_words, n_hit, items (sorted strings) and spans (character offsets of covered runs)."""
    shared = _blocks(items, item_col, item_text_col, block_bytes)
    out = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"),
    )
    for b, block in enumerate(shared):
        out = _scan_block(out, block, window, b == len(shared) - 1)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list:
    """The items as broadcasts of about ``block_bytes`` at most each."""
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-int(total * 1.25) // block_bytes)) if total > block_bytes else 1
    parts = [items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]
    return [items.sparkSession.sparkContext.broadcast([tuple(r) for r in part.distinct().collect()]) for part in parts]


def without_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows whose text holds no window of any item. Columns as before."""
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        docs = docs.filter(_clean(block, window)(F.col(text_col).cast("string")))
    return docs


def _clean(block, window: int):
    made: dict[str, object] = {}

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if "trie" not in made:
            made["trie"] = automaton(block.value, window)
        return pd.Series([not scan(made["trie"], words_of(t))[0].any() for t in texts], dtype=bool)

    return clean


def _scan_block(df: DataFrame, shared, window: int, last: bool) -> DataFrame:
    made: dict[str, object] = {}

    def run(batches):
        if "trie" not in made:
            made["trie"] = automaton(shared.value, window)
        for pdf in batches:
            rows = []
            for key, text, hits, items in zip(pdf["id"], pdf["text"], pdf["hits"], pdf["items"]):
                words = words_of(text)
                covered, found = scan(made["trie"], words)
                if hits is not None:
                    covered[np.asarray(hits, np.int64)] = True
                found |= set(items) if items is not None else set()
                if last:
                    n = int(covered.sum())
                    rows.append((key, len(words), n, sorted(found), [{"start": a, "end": b} for a, b in spans_of(text, covered)] if n else []))
                else:
                    rows.append((key, text, np.flatnonzero(covered).tolist(), sorted(found)))
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({"n_words": "int64", "n_hit": "int64"}) if last else out

    if last:
        names = ["id", "n_words", "n_hit", "items", "spans"]
        return df.mapInPandas(run, "id string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    names = ["id", "text", "hits", "items"]
    return df.mapInPandas(run, "id string, text string, hits array<int>, items array<string>")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS pat
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS pat
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
m AS (SELECT d.doc_id, d.k, d.n, p.item FROM d JOIN p ON d.pat = p.pat AND d.n = p.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
