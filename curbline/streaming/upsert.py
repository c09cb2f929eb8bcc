"""A keyed table that a stream's batches are merged into, each exactly once.

Rows lie in buckets by the hash of their key. A batch writes new versions of the buckets that it touches under its own number, then a manifest that says for every
bucket which version counts. Manifests appear by a rename and the one of the highest number is the table: a batch that failed half way has changed nothing, and
one that is run again finds its manifest there, or writes the same files once more.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    def _fs(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> tuple[int, dict[str, int]]:
        """The last batch merged, -1 for none, and each bucket's version."""
        fs, p = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not done:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/manifests/{max(done):012d}.json", wholetext=True).first()[0]
        return max(done), json.loads(text)

    def _commit(self, number: int, versions: dict[str, int]) -> None:
        fs, new = self._fs(f"{self.path}/manifests/{number:012d}.json.part")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        fs.rename(new, self._fs(f"{self.path}/manifests/{number:012d}.json")[1])

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self, versions: dict[str, int], only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{v}/_bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._files(self.manifest()[1])

    def merge(self, batch: DataFrame, number: int, order: str) -> bool:
        """Merges a batch, whose rows replace those of equal keys unless theirs is larger in order; False if it had been merged before."""
        last, versions = self.manifest()
        if number <= last:
            return False
        rows = batch.select(*self.schema.fieldNames()).withColumn("_bucket", self._bucket())
        touched = {str(r[0]) for r in rows.select("_bucket").distinct().collect()}  # at most as many as there are buckets
        if touched:
            old = self._files(versions, touched).withColumn("_bucket", self._bucket()).withColumn("_new", F.lit(0))
            latest = Window.partitionBy("_bucket", self.key).orderBy(F.desc(order), F.desc("_new"))
            merged = old.unionByName(rows.withColumn("_new", F.lit(1))).withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_new")
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        self._commit(number, versions | dict.fromkeys(touched, number))
        return True
