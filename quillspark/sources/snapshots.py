"""Tables that are replaced as a whole or by key in one step that readers can't see half of.

A table is a folder of data folders and numbered snapshot files. A snapshot lists the
data folders that make up the table, bucket by bucket; it is written beside its place
and put there by one rename, which fails if another writer was first. Readers take
the snapshot with the highest number, so they see a table before or after a change,
whatever else lies in the folder. A writer that stops early leaves folders that no
snapshot lists.

The rename must not replace a file that is there: so on HDFS and local disks; in
object stores without such a rename one writer at a time may commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket is made for when a table is created.
BUCKET_ROWS = 2_000_000


class Conflict(RuntimeError):
    """Another writer committed first; read the table anew and try again."""


class SnapshotTable:
    """The table at ``path``. ``keys``: its rows' key, by which they are replaced."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or []
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- snapshots

    def _numbers(self) -> list[int]:
        root = self._path(f"{self.path}/_snapshots")
        if not self._files.exists(root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def snapshot(self, number: int | None = None) -> dict:
        """The snapshot ``number``, or the latest: number, schema, buckets, keys, parts (folder lists by bucket)."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "schema": None, "buckets": 1, "keys": self.keys, "parts": {}}
        n = numbers[-1] if number is None else number
        stream = self._files.open(self._path(f"{self.path}/_snapshots/{n:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, seen: dict, parts: dict[str, list[str]], schema: dict, buckets: int) -> int:
        number = seen["number"] + 1
        body = json.dumps({"number": number, "schema": schema, "buckets": buckets, "keys": self.keys, "parts": parts})
        aside = self._path(f"{self.path}/_snapshots/.{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        try:
            out.write(body.encode("utf-8"))
        finally:
            out.close()
        place = self._path(f"{self.path}/_snapshots/{number:012d}.json")
        if self._files.exists(place) or not self._files.rename(aside, place):
            self._files.delete(aside, False)
            raise Conflict(f"snapshot {number} of {self.path} is there already")
        return number

    # --- reading

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot; of the latest if no number is given."""
        return self._rows(self.snapshot(number))

    def _rows(self, seen: dict, buckets: set[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        if seen["schema"] is None:
            raise FileNotFoundError(f"no snapshot in {self.path}")
        schema = StructType.fromJson(seen["schema"])
        folders = [f"{self.path}/{f}" for b, fs in seen["parts"].items() for f in fs if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Writes rows to a new folder, one inner folder a bucket; gives the folders by bucket."""
        folder = f"data-{uuid.uuid4().hex}"
        if buckets == 1:
            rows.write.parquet(f"{self.path}/{folder}")
            return {"0": [folder]}
        rows.withColumn("_bucket", self._bucket(buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        inner = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{folder}"))]
        return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in inner if n.startswith("_bucket=")}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int") if self.keys else F.lit(0)

    def replace(self, rows: DataFrame, buckets: int | None = None) -> int:
        """A full rebuild: ``rows`` are the table from now on. The number of buckets is chosen here."""
        seen = self.snapshot()
        buckets = buckets or (max(1, -(-rows.count() // BUCKET_ROWS)) if self.keys else 1)
        return self._commit(seen, self._write(rows, buckets), json.loads(rows.schema.json()), buckets)

    def append(self, rows: DataFrame) -> int:
        """Adds rows, whatever their keys."""
        seen = self.snapshot()
        if seen["schema"] is None:
            return self.replace(rows)
        parts = {b: list(fs) for b, fs in seen["parts"].items()}
        for b, fs in self._write(rows.select(*(f["name"] for f in seen["schema"]["fields"])), seen["buckets"]).items():
            parts[b] = parts.get(b, []) + fs
        return self._commit(seen, parts, seen["schema"], seen["buckets"])

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Rows whose key is in ``rows`` or ``gone`` leave the table, then ``rows`` enter it, in one step.

        A key may have several rows, which come and go together. Buckets without such a
        key stay as they are; at most all buckets' names come to the driver.
        """
        if not self.keys:
            raise ValueError("upsert needs keys")
        seen = self.snapshot()
        if seen["schema"] is None:
            return self.replace(rows)
        named = rows.select(*self.keys)
        named = (named if gone is None else named.unionByName(gone.select(*self.keys))).distinct()
        touched = {str(r[0]) for r in named.select(self._bucket(seen["buckets"])).distinct().collect()}
        if not touched:
            return seen["number"]
        other = named.withColumnsRenamed({k: f"_key_{k}" for k in self.keys})
        same = None
        for k in self.keys:
            one = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
            same = one if same is None else same & one
        kept = self._rows(seen, touched).join(other, same, "left_anti")
        written = self._write(kept.unionByName(rows.select(*kept.columns)), seen["buckets"])
        parts = {b: fs for b, fs in seen["parts"].items() if b not in touched} | written
        return self._commit(seen, parts, seen["schema"], seen["buckets"])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes data folders that none of the last ``keep`` snapshots lists, and older snapshots.

        Not while others write or read older snapshots. Gives the deleted folders.
        """
        numbers = self._numbers()
        listed = {f.split("/")[0] for n in numbers[-keep:] for fs in self.snapshot(n)["parts"].values() for f in fs}
        there = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        out = [n for n in there if n.startswith("data-") and n not in listed]
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.path}/_snapshots/{n:012d}.json"), False)
        for n in out:
            self._files.delete(self._path(f"{self.path}/{n}"), True)
        return out
