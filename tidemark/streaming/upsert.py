"""Incremental work: keyed upserts of feedback, waves of name families, memoised verdicts (W1, W3, W4).

Large state is kept in runs (class Runs): a batch writes its own rows only, and runs are merged as they grow, so what is written follows the batches and not the table.
Small state is a Parquet snapshot a batch (class Snapshots), read and written whole. Both are named by batch id, so a batch that is run again writes the same again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.explanations import latest_feedback
from tidemark.operators.harmonize import integrate
from tidemark.operators.mentions import near_tokens, ratios_between
from tidemark.session import cut

Merge = Callable[[DataFrame], DataFrame]


class Runs:
    """A table by key as runs of batches under one folder, newest last: run=<first batch>-<last batch>.

    merge() makes one row of the rows of a key, and is associative: run on parts and then on what came out, it gives the same. Reading merges all runs, once by key. After a batch,
    runs that together are as large as the one before them become one with it, as in a binary counter: a row is written again at most once each time its run doubles, and the runs
    are as many as the logarithm of the table's size. A run without its mark of success doesn't count, and of runs over the same batches the widest does.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Merge):
        self.spark, self.folder, self.merge = spark, folder.rstrip("/"), merge

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def found(self, below: int = 2**62) -> list[tuple[int, int]]:
        """The widest complete runs with batches before below, oldest first."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path())]
        runs = [tuple(map(int, n.removeprefix("run=").split("-"))) for n in names if n.startswith("run=") and files.exists(self._path(f"{n}/_SUCCESS"))]
        out: list[tuple[int, int]] = []
        for first, last in sorted((r for r in runs if r[1] < below), key=lambda r: (r[0], -r[1])):
            if not out or first > out[-1][1]:
                out.append((first, last))
        return out

    def size(self, run: tuple[int, int]) -> int:
        return self._files().getContentSummary(self._path(f"run={run[0]}-{run[1]}")).getLength()

    def read(self, runs: list[tuple[int, int]]) -> DataFrame | None:
        return self.merge(self.spark.read.parquet(*[f"{self.folder}/run={a}-{b}" for a, b in runs])) if runs else None

    def latest(self) -> DataFrame | None:
        return self.read(self.found())

    def write(self, batch: DataFrame, number: int) -> None:
        """The rows of a batch, merged among themselves, and then what is due of the runs before."""
        self.merge(batch).write.mode("overwrite").parquet(f"{self.folder}/run={number}-{number}")
        runs = self.found()
        due, total = [runs.pop()], 0
        total = self.size(due[0])
        while runs and (size := self.size(runs[-1])) <= total:
            total += size
            due.insert(0, runs.pop())
        if len(due) > 1:
            self.read(due).write.mode("overwrite").parquet(f"{self.folder}/run={due[0][0]}-{due[-1][1]}")

    def vacuum(self) -> None:
        """Remove runs that a wider one holds; not while somebody reads them."""
        files, kept = self._files(), {f"run={a}-{b}" for a, b in self.found()}
        for status in files.listStatus(self._path()):
            if status.getPath().getName().startswith("run=") and status.getPath().getName() not in kept:
                files.delete(status.getPath(), True)


class Snapshots:
    """Versions of a table under one folder, by batch id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        files, folder = self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if n.startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def before(self, batch: int) -> DataFrame | None:
        earlier = [v for v in self.versions() if v < batch]
        return self.spark.read.parquet(f"{self.folder}/batch={earlier[-1]}") if earlier else None

    def latest(self) -> DataFrame | None:
        files, _ = self._files()
        about = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/about.json")
        if files.exists(about):  # a table in runs
            kind = json.loads("".join(r.value for r in self.spark.read.text(str(about)).collect()))
            return Runs(self.spark, self.folder, newest(kind["keys"], kind["order"])).latest()
        return self.before(2**62)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")


def _each_batch(state: Snapshots, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    def run(batch: DataFrame, number: int) -> None:
        state.write(merge(state.before(number), batch), number)

    return run


def newest(keys: list[str], order: list[str]) -> Merge:
    return lambda df: latest_feedback(df, keys, order)


def upsert(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep the newest row of each key over all batches so far, in runs. A batch writes its own keys, without reading the table."""
    spark = stream.sparkSession
    state = Runs(spark, folder, newest(keys, order))
    about = spark._jvm.org.apache.hadoop.fs.Path(f"{state.folder}/about.json")
    out = about.getFileSystem(spark._jsc.hadoopConfiguration()).create(about, True)
    out.write(bytearray(json.dumps({"keys": keys, "order": order}).encode()))
    out.close()
    return stream.writeStream.foreachBatch(state.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FamilyWaves:
    """Master families (key, names) that waves of families are merged into by the likeness of their keys.

    A family of a wave joins the family of the known key with the highest ratio of at least least, the first key in a tie, else it is a new one; families of one wave are not compared with each other. Its key
    is known from then on, as a key of the family it belongs to. A wave is matched by tokens: the keys' rarest parts in a fixed order are kept as an index, to which a wave adds those of its own keys,
    in partitions by token of which only those of the wave are read. Families are kept in Runs; a wave writes its own names only. Waves are numbered, and one that is run again gives the same.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, key: str = "key", names: str = "names", least: float = 85.0):
        self.spark, self.key, self.names, self.least = spark, key, names, least
        self.families = Runs(spark, f"{folder.rstrip('/')}/families", lambda df: df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias(names)))
        self.index = f"{folder.rstrip('/')}/index"

    def _known(self, number: int) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.index)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        waves = [s.getPath().getName() for s in files.listStatus(path)]
        done = [w for w in waves if w.startswith("wave=") and int(w.removeprefix("wave=")) < number and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.index}/{w}/_SUCCESS"))]
        return self.spark.read.option("basePath", self.index).parquet(*[f"{self.index}/{w}" for w in done]) if done else None

    def integrate(self, wave: DataFrame, number: int) -> None:
        rows = cut(wave.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.flatten(F.collect_list(self.names)).alias(self.names)))
        bucket = F.pmod(F.xxhash64("g"), F.lit(self.BUCKETS)).cast("int")
        tokens = cut(near_tokens(rows.select(F.col(self.key).alias("a")), self.least).withColumn("bucket", bucket))
        known = self._known(number)
        if known is None:
            placed = rows.withColumn("target", F.col(self.key))
        else:
            touched = [r.bucket for r in tokens.select("bucket").distinct().collect()]  # BUCKETS at most
            pairs = ratios_between(tokens.drop("bucket"), known.where(F.col("bucket").isin(touched)).select("a", "n", "bits", "g", "target"), self.least)
            best = pairs.groupBy("a").agg(F.min_by("target", F.struct(-F.col("ratio"), F.col("b"))).alias("target"))
            placed = rows.join(best, F.col(self.key) == F.col("a"), "left").select(self.key, self.names, F.coalesce("target", self.key).alias("target"))
        placed = cut(placed)
        self.families.write(placed.select(F.col("target").alias(self.key), self.names), number)
        own = tokens.join(placed.select(F.col(self.key).alias("a"), "target"), "a")
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.index}/wave={number}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.integrate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def family_waves(stream: DataFrame, folder: str, checkpoint: str, key: str, names: str) -> StreamingQuery:
    """Integrate each batch of families into the master families; new keys are appended."""
    state = Snapshots(stream.sparkSession, folder)

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        return integrate(before if before is not None else batch.limit(0), batch, key, names)

    return stream.writeStream.foreachBatch(_each_batch(state, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memoised(rows: DataFrame, cache: DataFrame | None, key: str, judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verdicts of rows, and those to add to the cache: only rows whose key isn't in the cache are judged."""
    if cache is None:
        fresh = judge(rows)
        return fresh, fresh
    fresh = judge(rows.join(cache.select(key), key, "left_anti"))
    return rows.select(key).join(cache.unionByName(fresh), key), fresh


def windowed_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and kind, with a watermark: an extension of this library."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).getField("start").alias("start"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
