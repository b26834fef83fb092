"""What follows a repository as it grows. Every table but refs is only appended to, so its files are a stream's source.

Each follower keeps its progress in a checkpoint of its own and works off what is there (``availableNow``), or goes on
with an ``interval``. A batch that is repeated after a failure writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search
from ..operators.revisions import TABLES, Repository, commit_hash


def stream(repository: Repository, name: str) -> DataFrame:
    """A table of the repository as a stream of its new rows."""
    at, fs = repository._fs(name)
    fs.mkdirs(at)
    return repository.spark.readStream.schema(TABLES[name]).parquet(f"{repository.path}/{name}")


def log_stream(repository: Repository) -> DataFrame:
    """The repository's log as a stream: key, fields."""
    return stream(repository, "repo_log")


def events_by_type(log: DataFrame, seconds: int, late: int) -> DataFrame:
    """Counts of log entries (ts, type) by type in windows of some seconds; entries over ``late`` seconds behind the newest are dropped."""
    return log.withWatermark("ts", f"{late} seconds").groupBy(F.window("ts", f"{seconds} seconds"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def _start(df: DataFrame, apply, checkpoint: str, interval: str | None) -> StreamingQuery:
    out = df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)).start()


class SearchIndex:
    """Search documents of all graph revisions a repository has; derived once for each content hash, as commits come in.

    What is derived for another ``version`` of the derivation, or other labels and ids, isn't used: that index starts anew."""

    def __init__(self, repository: Repository, path: str, labels: tuple[str, ...], ids: tuple[str, ...] = (), version: str = "1"):
        self.repository, self.labels, self.ids = repository, labels, ids
        self.path = f"{path.rstrip('/')}/{commit_hash(version, *labels, '', *ids)[:16]}"

    def _documents(self) -> DataFrame | None:
        spark = self.repository.spark
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        return spark.read.parquet(f"{self.path}/documents") if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None

    def _apply(self, commits: DataFrame, batch: int) -> None:
        r = self.repository
        # a batch's own part is left out, so that a repeated batch derives it again
        graphs = r.table("ds_graphs").join(commits.select("ds_hash").distinct(), "ds_hash", "left_semi").select("ng", "hash").distinct()
        if (held := self._documents()) is not None:
            graphs = graphs.join(held.where(F.col("batch") != batch).select("hash"), "hash", "left_anti")
        t = r._by_hash("ng_revisions", graphs, "hash").select("hash", "ng", "s", "p", "o_kind", "o")
        docs = search.documents(t.withColumn("ng", F.col("hash")), self.labels, self.ids).withColumnRenamed("graph_uri", "hash")
        docs = graphs.join(docs, "hash").withColumnRenamed("ng", "graph_uri")
        docs.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/documents")

    def follow(self, interval: str | None = None) -> StreamingQuery:
        return _start(stream(self.repository, "commits"), self._apply, f"{self.path}/progress", interval)

    def rebuild(self) -> None:
        """From the beginning: the progress is forgotten."""
        spark = self.repository.spark
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.follow().awaitTermination()

    def documents(self, ds: str, branch: str = "master") -> DataFrame:
        """The documents of a branch's tip."""
        tip = self.repository.branches(ds).where(F.col("name") == branch).first()
        graphs = self.repository.graphs_of(tip["commit"]).select("hash")
        return self._documents().join(graphs, "hash", "left_semi").drop("batch", "hash").dropDuplicates(["graph_uri"])


def replicate(source: Repository, target: Repository, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keeps ``target`` in step with ``source``: every batch of new commits is synced. A batch without news copies nothing."""

    def apply(commits: DataFrame, batch: int) -> None:
        if not commits.isEmpty():
            target.sync_from(source)

    return _start(stream(source, "commits"), apply, checkpoint, interval)
