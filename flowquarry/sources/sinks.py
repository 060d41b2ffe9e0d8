"""Where results go: alerts, reports, rules and fitted pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowquarry.operators.scoring import Rule


def write_alerts(alerts: DataFrame, path: str) -> None:
    """One JSON object per alert, nested fields included."""
    alerts.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Evaluation tables have a row per class, so one file holds them."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_rules(spark: SparkSession, rules: Sequence[Rule], path: str) -> None:
    rows = [(i, r.text()) for i, r in enumerate(rules)]
    spark.createDataFrame(rows, "rule_no int, value string").coalesce(1).sortWithinPartitions("rule_no").select("value").write.mode(
        "overwrite"
    ).text(path)


def save_model(model: PipelineModel, features: Sequence[str], classes: Sequence[str], path: str) -> None:
    """The pipeline with its feature list and class map beside it."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
    spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "place int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], list[str]]:
    features = [r[0] for r in spark.read.parquet(f"{path}/features").orderBy("place").select("feature").collect()]
    classes = [r[0] for r in spark.read.parquet(f"{path}/classes").orderBy("place").select("label").collect()]
    return PipelineModel.load(f"{path}/pipeline"), features, classes


def stream_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Append a stream to files; each micro-batch is committed once."""
    return (
        stream.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_to_topic(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Append a (key, value) stream to a Kafka topic; needs the Kafka package on the cluster."""
    return (
        stream.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint).start()
    )
