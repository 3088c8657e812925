"""Collections of documents that are upserted by key, and survive retried batches and failed writes.

A collection is a folder of snapshots. Keys are dealt over buckets; an upsert rewrites the buckets it touches in a new
folder, and then adds one entry to the log, which names the folder of each bucket. The entry's file is made only if
no other has its number, so of two writers one is told and starts again from the other's snapshot; until the entry is
there, readers see the one before. An entry keeps the last batch of each writer, so a batch that comes again changes
nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class SchemaViolation(ValueError):
    """Rows that lack a required column, have it in another type, or lack a key."""


class Conflict(RuntimeError):
    """Another writer has made the same entry."""


class Collection:
    """``keys`` name a document; ``required`` (column -> type) must be there on every write. Of two documents with a key
    the one written last stays, or with ``newest`` the one that is greater in that column."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], required: dict[str, str] | None = None, newest: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.newest, self.buckets = spark, path.rstrip("/"), keys, newest, buckets
        self.required = required or {}
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        target, fs = self._fs(f"{self.path}/log")
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def entry(self) -> dict:
        """The newest entry of the log; a bucket that nothing was written to has no folder."""
        found = self.versions()
        if not found:
            return {"version": 0, "buckets": {}, "batches": {}, "schema": None}
        target, fs = self._fs(f"{self.path}/log/{found[-1]:020d}.json")
        stream = fs.open(target)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, entry: dict) -> None:
        """Write the entry aside, claim its number, which only one writer can, and rename it into the log. The claim of a
        writer that died in between is given back by ``abandon``."""
        number = f"{entry['version']:020d}.json"
        if entry["version"] in self.versions():
            raise Conflict(number)
        draft, fs = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        final, _ = self._fs(f"{self.path}/log/{number}")
        fs.mkdirs(final.getParent())
        claim, _ = self._fs(f"{self.path}/claims/{number}")
        if not fs.createNewFile(claim):
            raise Conflict(number)
        if not fs.rename(draft, final):
            raise Conflict(number)

    def abandon(self, version: int) -> bool:
        """Give back a number that a writer claimed and died before it made the entry; False if the entry is there."""
        if version in self.versions():
            return False
        claim, fs = self._fs(f"{self.path}/claims/{version:020d}.json")
        return fs.delete(claim, False)

    def check(self, rows: DataFrame) -> None:
        """Raise SchemaViolation if the rows break the contract."""
        kinds = dict(rows.dtypes)
        for name, kind in {**dict.fromkeys(self.keys), **self.required}.items():
            if name not in kinds:
                raise SchemaViolation(f"column {name} is missing")
            if kind and kinds[name] != kind:
                raise SchemaViolation(f"column {name} is {kinds[name]}, not {kind}")
        known = self.entry()["schema"]
        for field in StructType.fromJson(known).fields if known else []:
            if field.name in kinds and kinds[field.name] != field.dataType.simpleString():
                raise SchemaViolation(f"column {field.name} is {kinds[field.name]}, and was {field.dataType.simpleString()}")
        empty = None
        for k in self.keys:
            empty = F.col(k).isNull() if empty is None else empty | F.col(k).isNull()
        if rows.where(empty).limit(1).count():
            raise SchemaViolation("a key is null")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, entry: dict, wanted: list[int] | None = None) -> DataFrame | None:
        folders = [f"{folder}/bucket={b}" for b, folder in sorted(entry["buckets"].items()) if wanted is None or int(b) in wanted]
        if not entry["schema"]:
            return None
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The documents of the newest snapshot; None before the first write."""
        return self._read(self.entry())

    def upsert(self, rows: DataFrame, writer: str = "", batch: int | None = None, retries: int = 5) -> bool:
        """Add or replace documents; False if this writer's batch, or a later one, is there already. Of rows with one key
        the greatest stays, by ``newest`` first and then by all columns."""
        self.check(rows)
        for _ in range(retries):
            entry = self.entry()
            if batch is not None and entry["batches"].get(writer, -1) >= batch:
                return False
            new = rows.withColumn("bucket", self._bucket())
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most the buckets
            stored = self._read(entry, touched)
            both = new.withColumn("__fresh", F.lit(1))
            if stored is not None:
                both = both.unionByName(stored.withColumns({"bucket": self._bucket(), "__fresh": F.lit(0)}), allowMissingColumns=True)
            columns = [c for c in both.columns if c not in ("bucket", "__fresh")]
            # without `newest` fresh rows win; with it the greater one does, a fresh one of equals
            rank = F.struct(*([F.col(self.newest)] if self.newest else []), F.col("__fresh"), *(F.to_json(F.struct(F.col(c))) for c in columns))
            best = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*columns), rank).alias("d")).select("d.*", "bucket")
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            best.repartition("bucket").write.partitionBy("bucket").parquet(folder)
            schema = best.drop("bucket").schema
            after = {
                "version": entry["version"] + 1,
                "buckets": {**entry["buckets"], **{str(b): folder for b in touched}},
                "batches": {**entry["batches"], **({writer: batch} if batch is not None else {})},
                "schema": StructType([type(f)(f.name, f.dataType, True) for f in schema.fields]).jsonValue(),
            }
            try:
                self._commit(after)
            except Conflict:
                continue
            return True
        raise Conflict(f"no entry after {retries} tries")


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, writer: str) -> None:
    """Run a stream over all that is there, each batch an upsert; batches that Spark runs again change nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            collection.upsert(batch, writer, number)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
