"""Sources and sinks of streams, and running one over what is there."""

from __future__ import annotations

import socket
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_log(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON lines as an append-only log; blank lines are skipped."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def reachable(servers: str, timeout_s: float = 1.0) -> bool:
    """Whether any of ``host:port,...`` takes a connection."""
    for server in servers.split(","):
        host, _, port = server.strip().rpartition(":")
        try:
            with socket.create_connection((host, int(port)), timeout_s):
                return True
        except (OSError, ValueError):
            continue
    return False


def kafka_here(spark: SparkSession) -> bool:
    """Whether Spark's Kafka package is on the class path."""
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider", False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return True
    except Exception:  # the class loader's error comes through the gateway
        return False


def choose(spark: SparkSession, schema: T.StructType | str, log: str, servers: str | None = None, topic: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A stream of the topic, or of the log where that can't be, and what was chosen: mode, place and reason. A topic
    that is asked for and can't be read is told, never passed over in silence."""
    if not servers or not topic:
        reason = "no servers or topic given"
    elif not kafka_here(spark):
        reason = "Spark's Kafka package is missing"
    elif not reachable(servers):
        reason = f"no server of {servers} answers"
    else:
        return kafka(spark, servers, topic, schema), {"mode": "kafka", "place": f"{servers}/{topic}", "reason": "a server answers"}
    return json_log(spark, log, schema), {"mode": "log", "place": log, "reason": reason}


def kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str) -> DataFrame:
    """JSON values of a topic from the earliest offset. Needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def to_kafka(events: DataFrame, servers: str, topic: str) -> None:
    events.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Append goes to Parquet in ``folder``; the other
    modes keep the last batch's rows of each run, by foreachBatch, so a retried batch overwrites itself."""
    spark, path = stream.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/number={number}")

    query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/out").drop("number")
