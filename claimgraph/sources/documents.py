"""From files and tables to blocks and units, as DataFrames.

A parser turns (doc_id, text) into blocks (doc_id, pos, block_id, kind, text, headings); ``register_parser`` adds one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import strip

#: The suffixes of the kinds of documents.
SUFFIXES = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".bpmn": "bpmn"}
#: The elements of a BPMN process that are nodes of its flow.
FLOW_NODES = [
    "task", "userTask", "serviceTask", "scriptTask", "manualTask", "sendTask",
    "receiveTask", "businessRuleTask", "callActivity", "subProcess",
    "startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent",
    "boundaryEvent", "exclusiveGateway", "parallelGateway", "inclusiveGateway",
    "eventBasedGateway",
]
_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(modality: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    _PARSERS[modality] = parser


def parser_of(modality: str) -> Callable[[DataFrame], DataFrame]:
    return _PARSERS[modality]


def modality_of(path: Column) -> Column:
    """By suffix; null for others, which readers report or leave out."""
    out = None
    for suffix, modality in SUFFIXES.items():
        out = (F if out is None else out).when(F.lower(path).endswith(suffix), modality)
    return out


def registered(content: Column) -> tuple[Column, Column]:
    """(content_hash, doc_id) of raw bytes or text."""
    h = F.sha2(content.cast("binary"), 256)
    return h.alias("content_hash"), F.concat(F.lit("doc_"), F.substring(h, 1, 16)).alias("doc_id")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_uri, modality, content_hash, doc_id, text) of files of a known kind."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(F.col("path").alias("source_uri"), modality_of(F.col("path")).alias("modality"), *registered(F.col("content")), F.col("content").cast("string").alias("text"))
    return rows.filter("modality IS NOT NULL")


def first_copies(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per content_hash, the smallest source_uri, without those already in ``known``."""
    one = docs.groupBy("content_hash").agg(*[F.min_by(c, "source_uri").alias(c) for c in docs.columns if c != "content_hash"])
    return one if known is None else one.join(known.select("content_hash"), "content_hash", "left_anti")


def locked(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Documents that wait for a review of theirs."""
    return docs.join(patches.filter("status = 'pending'").select("doc_id"), "doc_id", "left_semi")


def blocks(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Non-blank parts of a text, with their place among all parts, blank ones included."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", re.escape(separator))).alias("pos", "text")).withColumn("text", strip(F.col("text")))
    return parts.filter("text <> ''").withColumn("block_id", F.concat_ws("_b", "doc_id", "pos"))


def heading_level(text: Column) -> Column:
    return F.length(F.regexp_extract(text, "^(#*)", 1))


def with_headings(parts: DataFrame) -> DataFrame:
    """Blocks with ``kind`` and ``headings``: the stack of titles above, a heading's own included.

    A heading cuts the stack to one less than its level and adds its title. Order decides, so the document's headings are folded once, as one
    array; a block takes the stack of the last heading up to it.
    """
    level = heading_level(F.col("text"))
    rows = parts.withColumn("level", level).withColumn("title", strip(F.ltrim(F.col("text"), F.lit("#"))))
    heads = rows.filter("level > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title"))).alias("heads"))
    empty, steps = F.array().cast("array<string>"), F.array().cast("array<struct<pos:int,stack:array<string>>>")
    above = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["stack"], empty)
    grown = lambda acc, h: F.concat(F.slice(above(acc), F.lit(1), h["level"] - 1), F.array(h["title"]))
    add = lambda acc, h: F.concat(acc, F.array(F.struct(h["pos"].alias("pos"), grown(acc, h).alias("stack"))))
    heads = heads.select("doc_id", F.explode(F.aggregate("heads", steps, add)).alias("h")).select("doc_id", F.col("h.pos").alias("pos"), F.col("h.stack").alias("own"))
    rows = rows.join(heads, ["doc_id", "pos"], "left")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.coalesce(F.last("own", ignorenulls=True).over(so_far), empty)
    kind = F.when(F.col("level") > 0, "heading").otherwise("paragraph")
    return rows.withColumn("headings", stack).withColumn("kind", kind).drop("own", "level", "title")


def markdown(docs: DataFrame) -> DataFrame:
    return with_headings(blocks(docs))


def units(parts: DataFrame) -> DataFrame:
    """What extraction reads: blocks that aren't headings, blank or structured (``bpmn_...``, whose facts are given)."""
    keep = (F.col("kind") != "heading") & (strip(F.col("text")) != "") & ~F.col("kind").startswith("bpmn_")
    return parts.filter(keep).withColumn("unit_id", F.concat("block_id", F.lit("_u0")))


def transcript(turns: DataFrame) -> DataFrame:
    """A conversation's turns as blocks: ``role: text``."""
    text = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), strip(F.coalesce("text", F.lit(""))))
    rows = turns.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("pos"), text.alias("text"))
    return rows.withColumn("block_id", F.concat_ws("_b", "doc_id", "pos")).withColumn("kind", F.lit("utterance"))


def html_paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraph elements of pages as blocks, up to their end, the next paragraph's or the article's, tags dropped: a plain stand-in for a layout parser."""
    found = F.slice(F.split("html", "<p>"), 2, 2**30)
    rows = pages.filter("html IS NOT NULL").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("doc_id"), F.posexplode(found).alias("pos", "text"))
    text = F.regexp_replace("text", "(?s)(</p>|</article>).*", "")
    rows = rows.withColumn("text", strip(F.regexp_replace(text, "<[^>]*>", "")))
    return rows.filter("text <> ''").withColumn("block_id", F.concat_ws("_b", "doc_id", "pos")).withColumn("kind", F.lit("paragraph"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def bpmn_triples(docs: DataFrame) -> DataFrame:
    """(batch, pos, subject, predicate, object, props) of BPMN documents (doc_id, text): what each flow node IS_A, and what FLOWS_TO what."""
    import xml.etree.ElementTree as ET

    def read(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                try:
                    root = ET.fromstring(text)
                except ET.ParseError:
                    continue
                names, found, flows = {}, [], []
                for e in root.iter():
                    tag = _local(e.tag)
                    if tag in FLOW_NODES:
                        name = e.get("name") or e.get("id")
                        names[e.get("id")] = name
                        found.append((name, "IS_A", tag, {}))
                    elif tag == "sequenceFlow":
                        flows.append(e)
                found.sort(key=lambda r: FLOW_NODES.index(r[2]))
                for e in flows:
                    a, b = e.get("sourceRef"), e.get("targetRef")
                    if a and b:  # an end that is no flow node goes by its id
                        condition = e.get("name")
                        found.append((names.get(a, a), "FLOWS_TO", names.get(b, b), {} if condition is None else {"condition": condition}))
                rows += [(doc, i, *r) for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=["batch", "pos", "subject", "predicate", "object", "props"])

    return docs.select("doc_id", "text").mapInPandas(read, "batch string, pos long, subject string, predicate string, object string, props map<string,string>")


def bpmn(docs: DataFrame) -> DataFrame:
    """Flow nodes as blocks."""
    nodes = bpmn_triples(docs).filter("predicate = 'IS_A'")
    return nodes.select(F.col("batch").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("subject").alias("text"), F.concat_ws("_b", "batch", "pos").alias("block_id"), F.concat(F.lit("bpmn_"), "object").alias("kind"), F.array().cast("array<string>").alias("headings"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold triples beside documents: ``<doc>.gold.json``, an array of objects."""
    rows = spark.read.option("multiLine", "true").json(path).withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.gold\.json$", 1))
    return rows.withColumn("pos", F.monotonically_increasing_id())


register_parser("markdown", markdown)
register_parser("bpmn", bpmn)
