"""Versioned Parquet snapshots: new folders for the tables that changed, then one manifest that names them all.

Readers follow the newest manifest, so a commit's facts and its ledger appear together or not at all. Everything goes
through Hadoop's file system, so any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from claimgraph.schemas import TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)

    def version(self) -> int:
        """0 if nothing was written."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{version}.json").first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = self.manifest(version).get(name)
        return self.spark.read.schema(TABLES[name]).parquet(at) if at else self.spark.createDataFrame([], TABLES[name])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.read(name, version) for name in TABLES}

    def publish(self, changed: dict[str, DataFrame]) -> int:
        """Write the tables, then the manifest under a name that must not exist: of two writers one fails and nothing is lost."""
        before, version = self.manifest(), self.version() + 1
        for name, df in changed.items():
            at = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex[:12]}"  # a writer that loses leaves the winner's files alone
            df.select(*self.spark.createDataFrame([], TABLES[name]).columns).write.parquet(at)
            before[name] = at
        out = self._fs.create(self._path(f"{self.root}/manifests/{version}.json"), False)
        out.write(bytearray(json.dumps(before, sort_keys=True).encode()))
        out.close()
        return version

    def reset(self) -> int:
        """Empty tables as a new version."""
        return self.publish({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()})
