"""Tables that take upserts batch by batch: key buckets, copy-on-write, a version for each batch.

A table is a folder in a store that Spark writes to. Rows are dealt to buckets
by the hash of their key; a batch rewrites only the buckets that it touches,
under its own version, and then writes a manifest that names the version of
every bucket. A reader takes the newest manifest that was finished, so it sees
a batch as a whole or not at all. A batch that is run again after a failure
starts from the manifest before it and writes the same files, so it changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_MANIFEST = "bucket int, version long"


class VersionedTable:
    """Rows of ``schema``, one for each value of ``keys``, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions with a manifest: it is one file, which is there as a whole or not at all."""
        return self._numbers(f"{self.folder}/manifest")

    def _numbers(self, folder: str) -> list[int]:
        """The numbers of the ``name=number`` folders that hold the Parquet files below ``folder``; no file is read."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet") \
                .load(folder).select("path").collect()
        except AnalysisException:
            return []
        names = (r["path"].split("/")[-2] for r in files)
        return sorted({int(n.split("=")[1]) for n in names if "=" in n})

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket that has rows; of the newest manifest (below ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/v={known[-1]}").collect()  # a row per bucket
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/v={v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self._manifest())

    def before(self, version: int) -> DataFrame:
        """The table as it was before a version."""
        return self._read(self._manifest(before=version))

    def upsert(self, rows: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Write ``rows`` (a row for each key) as ``version``; ``merge(old, new)`` gives the rows of the touched buckets.

        By default a new row replaces the old one of its key. A merge may use further columns of ``rows``.
        """
        rows = rows.persist()
        try:
            places = self._manifest(before=version)
            touched = sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most one per bucket
            old = self._read({b: places[b] for b in touched if b in places})
            merged = (merge or self._replace)(old, rows).select(*self.schema.fieldNames())
            merged.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket") \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v={version}")
            left = self._numbers(f"{self.folder}/data/v={version}")  # a merge may leave buckets without rows
            places = {b: v for b, v in places.items() if b not in touched} | {b: version for b in left if b in touched}
            self.spark.createDataFrame(sorted(places.items()), _MANIFEST).coalesce(1) \
                .write.mode("overwrite").parquet(f"{self.folder}/manifest/v={version}")
        finally:
            rows.unpersist()

    def _replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*self.schema.fieldNames()).withColumn("_new", F.lit(1)))
        w = Window.partitionBy(*self.keys).orderBy(F.desc("_new"))
        return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")

    def clean(self, keep: int = 2) -> None:
        """Empty the data of versions that none of the last ``keep`` manifests names."""
        known = self.versions()
        used = set()
        for v in known[-keep:]:
            used |= set(self._manifest(before=v + 1).values())
        for v in known[:-keep]:
            if v not in used:
                self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.folder}/data/v={v}")
