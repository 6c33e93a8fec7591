"""A keyed table on plain files that micro-batches update: versioned buckets, rewritten only where a batch touches them.

A row's bucket is the period of its date, where the table has one, and a hash of its key. A batch reads the buckets in
which it has rows, merges its rows into them by the table's rule and writes these buckets anew, as one version named
by the batch id. A manifest per version says which version holds each bucket; it is put in place by a rename after all
data is written, so a reader sees a whole version or the one before. A batch that is tried again finds its manifest and
does nothing, or finds none and overwrites what it had begun. Versions that no kept manifest names are deleted.

What a batch costs follows from the buckets it touches, not from the size of the table: with a period, reports of this
month leave the buckets of all earlier months alone. A manifest has one short line per bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """Rows unique by ``keys``, below a folder that all executors share.

    ``rule(rows, keys)`` gets rows that may share keys, those stored and those of a batch, and returns one per key with the
    same columns; it has to give the same result in whatever batches rows arrive, as a minimum or maximum does.
    ``period`` is a date column among the keys, cut by ``period_format``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], rule: Callable[[DataFrame, list[str]], DataFrame],
                 buckets: int = 16, period: str | None = None, period_format: str = "yyyyMM", keep: int = 2):
        self.spark, self.folder, self.schema, self.keys, self.rule = spark, folder, schema, list(keys), rule
        self.columns = schema.fieldNames()
        self.buckets, self.period, self.period_format, self.keep = buckets, period, period_format, keep
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((folder, *map(str, parts))))
        self._store = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Versions whose manifest is in place, oldest first."""
        place = self._path("manifests")
        if not self._store.exists(place):
            return []
        names = [f.getPath().getName() for f in self._store.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict[str, int]:
        """Version that holds each bucket, by bucket name; the newest manifest unless one is named."""
        known = self.versions()
        if not known:
            return {}
        stream = self._store.open(self._path("manifests", f"{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict[str, int]) -> None:
        begun = self._path("manifests", f".{version}.json.begun")
        stream = self._store.create(begun, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if not self._store.rename(begun, self._path("manifests", f"{version}.json")):
            raise RuntimeError(f"manifest {version} of {self.folder} could not be put in place")

    def _delete_old(self) -> None:
        known = self.versions()
        live = {(v, b) for version in known[-self.keep:] for b, v in self.manifest(version).items()}
        for version in known[:-self.keep]:
            for bucket, v in self.manifest(version).items():
                if (v, bucket) not in live:
                    self._store.delete(self._path(f"v={v}", f"bucket={bucket}"), True)
            self._store.delete(self._path("manifests", f"{version}.json"), False)

    # --- rows ----------------------------------------------------------------------------

    def _bucket(self):
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        if self.period is None:
            return number
        return F.concat_ws("-", F.coalesce(F.date_format(self.period, self.period_format), F.lit("none")), number)

    def rows_of(self, manifest: dict[str, int]) -> DataFrame:
        folders = [str(self._path(f"v={v}", f"bucket={b}")) for b, v in sorted(manifest.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """All rows as of a version that is still kept, by default the newest."""
        return self.rows_of(self.manifest(version))

    def merge(self, batch: DataFrame, version: int) -> list[str]:
        """Merge a batch as this version and return the buckets it rewrote; nothing where the version is already there.

        Versions rise, as the ids of micro-batches do. The batch is written first, as it is read twice.
        """
        known = self.versions()
        if known and known[-1] >= version:
            return []
        manifest = self.manifest(known[-1]) if known else {}
        staged = f"{self.folder}/staged/v={version}"
        batch.select(*self.columns).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(staged)
        fresh = self.spark.read.schema(T.StructType([*self.schema.fields]).add("bucket", "string")).parquet(staged)
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if touched:
            stored = self.rows_of({b: manifest[b] for b in touched if b in manifest}).withColumn("bucket", self._bucket())
            # rows meet by bucket, which serves the rule's keys and leaves one file per bucket: one exchange for both
            both = stored.unionByName(fresh).repartition(len(touched), "bucket")
            self.rule(both, ["bucket", *self.keys]).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={version}")
        self._commit(version, manifest | dict.fromkeys(touched, version))
        self._store.delete(self._path("staged", f"v={version}"), True)
        self._delete_old()
        return touched
