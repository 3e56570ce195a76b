"""Incremental sync of a catalog, with checkpoints and a watermark that commit together or not at all.

A run takes the catalog's files modified since the baseline, drops those that equal their checkpoint, processes the
rest, and commits. All state is in one folder that driver and executors share:

    runs/<id>/checkpoints   the files that this run processed, as they were (Parquet)
    runs/<id>/done          {"seq", "watermark", ...}: written last, in one step

Only runs with `done` count, so a run that breaks off before leaves nothing behind; its next try, under the same id,
writes over what it left. A run whose id has committed is not run again, which makes a stream's batches, with their
numbers as ids, take effect once. The watermark moves only in runs that process files and have no failures,
so files that failed are found again.

The baseline is the given time, else the last watermark of the folder, else the catalog's own, else none (all files).
Times compare strictly: a file modified at the baseline does not count. A null modification time never counts as
changed. A file without checkpoint counts as changed, and so does one whose time or size differs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.scratch import folders, remove
from docmill.streaming.events import changed

CHECKPOINTS = "id string, modified timestamp, size long, seq long"
#: Runs after which the checkpoints are written together.
COMPACT_AFTER = 20


class Sync:
    """Sync state in a folder. Catalogs: id, modified, size, and trashed if they have it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ------------------------------------------------------------ the folder

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, *names: str) -> dict | None:
        path, system = self._path(*names), self._system()
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _write(self, value: dict, *names: str) -> None:
        """The file appears whole or not at all: it is written under another name first."""
        path, system = self._path(*names), self._system()
        early = self._path(*names[:-1], f"_{names[-1]}")
        stream = system.create(early, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if not system.rename(early, path):
            raise OSError(f"{path} could not be written")

    def commits(self) -> dict[str, dict]:
        """Committed runs by id, in the order of their commit."""
        found = {name: self._read("runs", name, "done") for name in folders(self.spark, f"{self.folder}/runs")}
        return dict(sorted(((k, v) for k, v in found.items() if v), key=lambda kv: kv[1]["seq"]))

    def watermark(self) -> str | None:
        """The time of the last run without failures."""
        marks = [v["watermark"] for v in self.commits().values() if v["watermark"]]
        return marks[-1] if marks else None

    def checkpoints(self) -> DataFrame:
        """id, modified, size of each file as it was when it was last processed."""
        paths = [f"{self.folder}/runs/{name}/checkpoints" for name in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], CHECKPOINTS).drop("seq")
        rows = self.spark.read.schema(CHECKPOINTS).parquet(*paths)
        return rows.groupBy("id").agg(F.max_by(F.struct("modified", "size"), "seq").alias("last")).select("id", "last.modified", "last.size")

    # ------------------------------------------------------------ changes

    def baseline(self, since: str | None = None, catalog_since: str | None = None) -> str | None:
        return since or self.watermark() or catalog_since

    def pending(self, catalog: DataFrame, since: str | None = None, catalog_since: str | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame]:
        """Files changed since the baseline, and those of them to process: all, or those that differ from their checkpoint."""
        files = catalog.filter("not coalesce(cast(trashed as boolean), false)") if "trashed" in catalog.columns else catalog
        files = files.withColumns({"id": F.col("id").cast("string"), "modified": F.col("modified").cast("timestamp"), "size": F.coalesce(F.col("size").cast("long"), F.lit(0))}).filter("modified is not null")
        base = self.baseline(since, catalog_since)
        moved = files.filter(F.col("modified") > F.lit(base).cast("timestamp")) if base else files
        return moved, moved if everything else changed(moved, "0001-01-01", self.checkpoints())

    # ------------------------------------------------------------ runs

    def run(self, catalog: DataFrame, process: Callable[[DataFrame], DataFrame], run_id: str | None = None, since: str | None = None, catalog_since: str | None = None, everything: bool = False, most: int | None = None, now: str | None = None) -> dict:
        """One run: process(files) gives (id, ok) of the files. Returns what was done.

        now: the time that counts as the run's, its start if not given. most: files processed at once, by id; the rest
        wait, and the watermark with them.
        """
        done = self.commits()
        seq = max((v["seq"] for v in done.values()), default=-1) + 1
        run_id = run_id or f"run-{seq}"
        if run_id in done:
            return done[run_id] | {"status": "done_before"}
        now = now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        moved, todo = self.pending(catalog, since, catalog_since, everything)
        total, pending = moved.count(), todo.count()
        if most is not None and pending > most:
            todo = todo.orderBy("id").limit(most)
        path = f"{self.folder}/runs/{run_id}/checkpoints"
        kept = todo.select("id", "modified", "size")
        # a file without a result has failed
        results = process(todo).groupBy(F.col("id").cast("string").alias("rid")).agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
        good = kept.join(results, F.col("id") == F.col("rid")).filter("ok").select("id", "modified", "size", F.lit(seq).cast("long").alias("seq"))
        good.write.mode("overwrite").parquet(path)
        worked = self.spark.read.schema(CHECKPOINTS).parquet(path).count()
        taken = min(pending, most) if most is not None else pending
        failed, waiting = taken - worked, pending - taken
        summary = {"seq": seq, "total_changed": total, "reprocessed": worked, "skipped": total - pending, "failed": failed, "waiting": waiting, "watermark": None if failed or waiting or not taken else now, "status": "completed_with_errors" if failed else "completed" if taken else "nothing_changed"}
        self._write(summary, "runs", run_id, "done")
        if len(done) + 1 >= COMPACT_AFTER and not run_id.startswith("batch-"):
            self.compact()
        return summary

    def compact(self) -> None:
        """Writes all checkpoints as those of one new run, then drops the runs before it."""
        done = self.commits()
        seq = max(v["seq"] for v in done.values()) + 1
        self.checkpoints().withColumn("seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/runs/run-{seq}/checkpoints")
        self._write({"seq": seq, "watermark": self.watermark(), "status": "compacted"}, "runs", f"run-{seq}", "done")
        for name in done:
            remove(self.spark, f"{self.folder}/runs/{name}")

    def stream(self, files: DataFrame, process: Callable[[DataFrame], DataFrame], checkpoint: str):
        """Runs each batch of a stream of catalog rows as a run; a batch that Spark repeats takes effect once."""

        def batch(rows: DataFrame, number: int) -> None:
            last = Window.partitionBy("id").orderBy(F.desc("modified"), F.desc("size"))
            latest = rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")
            self.run(latest, process, f"batch-{number}", since="0001-01-01 00:00:00")

        return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
