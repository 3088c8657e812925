"""A lake of Hive-partitioned Parquet datasets in zones, with a manifest for each."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("raw", "curated", "features", "analytics")


class Lake:
    """``root`` may be a path of any store that Spark reads: local, hdfs:// or another."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, zone: str, dataset: str) -> str:
        if zone not in ZONES:
            raise ValueError(f"unknown zone {zone!r}; zones are {', '.join(ZONES)}")
        return f"{self.root}/{zone}/{dataset}"

    def write(self, df: DataFrame, zone: str, dataset: str, partition_by: tuple[str, ...] = ("symbol", "year")) -> DataFrame:
        """Replace a dataset and return its manifest. An empty frame is refused; ``year`` comes from ``date`` if
        it is a partition; partitions that the frame lacks are left out."""
        if df.isEmpty():
            raise ValueError(f"refused to write an empty {zone}/{dataset}")
        if "year" in partition_by and "year" not in df.columns and "date" in df.columns:
            df = df.withColumn("year", F.year("date"))
        keys = [c for c in partition_by if c in df.columns]
        df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(self.path(zone, dataset)) if keys else df.write.mode("overwrite").parquet(self.path(zone, dataset))
        return self.manifest(zone, dataset)

    def read(self, zone: str, dataset: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(zone, dataset))
        df = df.where(where) if where else df
        return df.select(*columns) if columns else df

    def manifest(self, zone: str, dataset: str) -> DataFrame:
        """(zone, dataset, rows, files, bytes, columns) of what is stored."""
        df = self.read(zone, dataset).select("*", "_metadata.file_path", "_metadata.file_size")
        files = df.groupBy("file_path").agg(F.count("*").alias("rows"), F.max("file_size").alias("bytes"))
        return files.agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")).select(
            F.lit(zone).alias("zone"), F.lit(dataset).alias("dataset"), "rows", "files", "bytes", F.array(*map(F.lit, sorted(df.columns[:-2]))).alias("columns")
        )

    def copy(self, zone: str, dataset: str, to_zone: str, to_dataset: str) -> None:
        """The dataset's files, byte for byte, under other names; partitions keep theirs. The driver streams the bytes."""
        source, target = self.path(zone, dataset), self.path(to_zone, to_dataset)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(source).getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(source), fs, jvm.org.apache.hadoop.fs.Path(target), False, conf)
        found = fs.listFiles(jvm.org.apache.hadoop.fs.Path(target), True)
        paths = []
        while found.hasNext():
            paths.append(found.next().getPath())
        for i, path in enumerate(p for p in paths if p.getName().endswith(".parquet")):
            fs.rename(path, jvm.org.apache.hadoop.fs.Path(path.getParent(), f"copy-{i:05d}.parquet"))

    def fingerprint(self, zone: str, dataset: str) -> DataFrame:
        """(files, digest): SHA-256 over the sorted digests of the files, whatever their order or names."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.path(zone, dataset))
        digests = files.select(F.sha2("content", 256).alias("d"))
        return digests.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "").cast("binary"), 256).alias("digest"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a new folder of this machine serves a local master, as
    in tests; on a cluster, whose executors wouldn't see it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, and safe from lost executors. It goes when the
    driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by those with the same keys, and the new ones added."""
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def find(df: DataFrame, equal: dict | None = None, sort: list[tuple[str, int]] | None = None, limit: int = 0) -> DataFrame:
    """Rows whose columns equal values (null equals null), sorted with null last going up and first going
    down; limit 0 means all."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    if sort:
        df = df.orderBy(*(F.col(c).asc_nulls_last() if way > 0 else F.col(c).desc_nulls_first() for c, way in sort))
    return df.limit(limit) if limit else df


def merge_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, value) of both, the new value where both have one; sorted by path at the sink."""
    return old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "path", "full").select("path", F.coalesce("new", "old").alias("value"))
