"""A graph, its ledger and a staging area derived from the driver's tables, and the same in DuckDB SQL (``WITH`` parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.operators.temporal import supersede

ENTITIES_SQL = """
entities AS (
  SELECT 'C#' || c_custkey AS id, c_name AS name, 'Agent' AS entity_type, c_mktsegment AS description FROM customer
  UNION ALL SELECT 'S#' || s_suppkey, s_name, 'Agent', NULL FROM supplier
  UNION ALL SELECT 'N#' || n_nationkey, n_name, 'Place', NULL FROM nation
  UNION ALL SELECT 'R#' || r_regionkey, r_name, 'Place', NULL FROM region
  UNION ALL SELECT 'P#' || p_partkey, p_name, 'Artifact', p_type FROM part
  UNION ALL SELECT DISTINCT 'Q#' || o_orderpriority, o_orderpriority, 'Concept', NULL FROM orders)"""
EDGES_SQL = """
chain AS (
  SELECT 'HP#' || o_orderkey AS id, 'C#' || o_custkey AS subject_id, 'Q#' || o_orderpriority AS object_id, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
    lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders),
edges AS (
  SELECT 'LC#' || c_custkey AS id, 'C#' || c_custkey AS subject_id, 'N#' || c_nationkey AS object_id, 'located_in' AS predicate,
    CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to, CAST(1 AS BIGINT) AS support FROM customer
  UNION ALL SELECT 'LS#' || s_suppkey, 'S#' || s_suppkey, 'N#' || s_nationkey, 'located_in', NULL, NULL, 1 FROM supplier
  UNION ALL SELECT 'PR#' || n_nationkey, 'N#' || n_nationkey, 'R#' || n_regionkey, 'part_of', NULL, NULL, 1 FROM nation
  UNION ALL SELECT 'SP#' || l_suppkey || '_' || l_partkey, 'S#' || l_suppkey, 'P#' || l_partkey, 'supplies', min(strftime(l_shipdate, '%Y-%m-%d')), NULL, count(*)
    FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT id, subject_id, object_id, 'has_priority', valid_from, valid_to, 1 FROM chain WHERE valid_to IS NULL OR valid_to > valid_from)"""
OPS_SQL = """
ops AS (
  SELECT 'p' || l_orderkey AS patch_id, 'op' || l_orderkey || '-' || n AS op_id, n AS pos,
    CASE l_returnflag WHEN 'A' THEN 'assert_edge' WHEN 'R' THEN 'invalidate_edge' ELSE 'create_node' END AS op,
    CASE WHEN n > 1 THEN 'op' || l_orderkey || '-' || (n - 1) END AS dep,
    round(1 - l_discount, 2) AS extraction, CAST(floor(l_quantity / 10) AS INTEGER) AS support, round(l_tax * 12, 2) AS resolution,
    l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 40 AS new_type, l_quantity < 3 AS semantic,
    'C#' || l_suppkey AS subject_id, 'P#' || l_partkey AS object_id, 'S#' || l_suppkey AS supplier_id,
    strftime(l_shipdate, '%Y-%m-%d') AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS n FROM lineitem)),
scored AS (
  SELECT *, round(0.35 * extraction + 0.25 * least(support / 3.0, 1.0) + 0.25 * resolution + 0.15 * CASE WHEN new_type THEN 0 ELSE 1 END, 4) AS confidence FROM ops),
routed AS (
  SELECT *, CASE WHEN new_type OR semantic THEN 'review' WHEN confidence >= 0.92 THEN 'approve' WHEN confidence < 0.30 THEN 'reject' ELSE 'review' END AS route FROM scored),
staged AS (SELECT *, CASE route WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status FROM routed)"""


class Graph:
    """The derived tables, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def entities(self) -> DataFrame:
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        none = F.lit(None).cast("string")
        parts = [
            self.table("customer").select(key("C#", "c_custkey"), "c_name", F.lit("Agent"), "c_mktsegment"),
            self.table("supplier").select(key("S#", "s_suppkey"), "s_name", F.lit("Agent"), none),
            self.table("nation").select(key("N#", "n_nationkey"), "n_name", F.lit("Place"), none),
            self.table("region").select(key("R#", "r_regionkey"), "r_name", F.lit("Place"), none),
            self.table("part").select(key("P#", "p_partkey"), "p_name", F.lit("Artifact"), "p_type"),
            self.table("orders").select(key("Q#", "o_orderpriority"), "o_orderpriority", F.lit("Concept"), none).distinct(),
        ]
        return self._all(parts, ["id", "name", "entity_type", "description"])

    @staticmethod
    def _all(parts: list[DataFrame], names: list[str]) -> DataFrame:
        out = parts[0].toDF(*names)
        for p in parts[1:]:
            out = out.union(p.toDF(*names))
        return out

    def priorities(self) -> DataFrame:
        """The windows in which each customer had a priority."""
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        seen = self.table("orders").select(
            F.concat(F.lit("HP#"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("C#"), F.col("o_custkey").cast("string")).alias("subject_id"),
            F.concat(F.lit("Q#"), "o_orderpriority").alias("object_id"), "o_orderdate", "o_orderkey", day.alias("at"),
        )
        return supersede(seen, ["subject_id"], ["o_orderdate", "o_orderkey"], "at").drop("o_orderdate", "o_orderkey")

    def edges(self) -> DataFrame:
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
        located = lambda t, p, q, k, n: self.table(t).select(key(q, k), key(p, k), key("N#", n), F.lit("located_in"), none, none, one)
        supplied = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"), F.count("*").alias("n"))
        chain = self.priorities()
        parts = [
            located("customer", "C#", "LC#", "c_custkey", "c_nationkey"),
            located("supplier", "S#", "LS#", "s_suppkey", "s_nationkey"),
            self.table("nation").select(key("PR#", "n_nationkey"), key("N#", "n_nationkey"), key("R#", "n_regionkey"), F.lit("part_of"), none, none, one),
            supplied.select(F.concat_ws("_", key("SP#", "l_suppkey"), F.col("l_partkey").cast("string")), key("S#", "l_suppkey"), key("P#", "l_partkey"), F.lit("supplies"), "d", none, "n"),
            chain.select("id", "subject_id", "object_id", F.lit("has_priority"), "valid_from", "valid_to", one),
        ]
        return self._all(parts, ["id", "subject_id", "object_id", "predicate", "valid_from", "valid_to", "support"])

    def ops(self) -> DataFrame:
        """An op a line item: kinds by return flag, each op after an order's first depends on the one before."""
        from claimgraph.operators import scoring

        place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
        order, line = F.col("l_orderkey").cast("string"), F.col("n")
        kind = F.when(F.col("l_returnflag") == "A", "assert_edge").when(F.col("l_returnflag") == "R", "invalidate_edge").otherwise("create_node")
        op_id = lambda n: F.concat(F.lit("op"), order, F.lit("-"), n.cast("string"))
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        rows = self.table("lineitem").withColumn("n", F.row_number().over(place)).select(
            key("p", "l_orderkey").alias("patch_id"), op_id(line).alias("op_id"), line.alias("pos"), kind.alias("op"), F.when(line > 1, op_id(line - 1)).alias("dep"),
            F.round(1 - F.col("l_discount"), 2).alias("extraction"), F.floor(F.col("l_quantity") / 10).cast("int").alias("support"), F.round(F.col("l_tax") * 12, 2).alias("resolution"),
            ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)).alias("new_type"), (F.col("l_quantity") < 3).alias("semantic"),
            key("C#", "l_suppkey").alias("subject_id"), key("P#", "l_partkey").alias("object_id"), key("S#", "l_suppkey").alias("supplier_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        )
        rows = rows.withColumn("confidence", scoring.score(F.col("extraction"), F.col("support"), F.col("resolution"), ~F.col("new_type")))
        rows = rows.withColumn("route", scoring.route(F.col("op"), F.col("confidence"), F.col("new_type"), F.col("semantic")))
        return rows.withColumn("status", scoring.status_of(F.col("route")))

    def ledger(self) -> DataFrame:
        """A line item is the op that wrote its supplier's edge; its order is the document."""
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return self.table("lineitem").select(
            F.concat_ws("-", key("op", "l_orderkey"), F.col("l_linenumber").cast("string")).alias("op_id"), key("O#", "l_orderkey").alias("doc_id"),
            F.concat_ws("_", key("SP#", "l_suppkey"), F.col("l_partkey").cast("string")).alias("edge_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"),
        )

    def sources(self) -> DataFrame:
        """Documents behind the ledger; their uri holds the order's date."""
        key = F.concat(F.lit("O#"), F.col("o_orderkey").cast("string"))
        return self.table("orders").select(key.alias("doc_id"), F.concat(key, F.lit("@"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("source_uri"))

    def texts(self) -> DataFrame:
        """documents as (doc_id string, text, source_uri, content_hash)."""
        from claimgraph.sources.documents import registered

        rows = self.table("documents").withColumn("text", F.coalesce("text", F.lit("")))
        return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("source_uri"), registered(F.col("text"))[0])
