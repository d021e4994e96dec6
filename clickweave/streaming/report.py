"""What a stream has done over its whole life.

The ad stream adds its counts to a table with each batch (``report_table``). Other queries observe their lines, and ``LifeReport`` listens: a small JSON
file for each finished batch below a shared folder, named after the batch, so a batch that is reported again replaces itself. From
``MOST_FILES`` on they are added up in one file.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from clickweave import schemas
from clickweave.streaming.tables import StreamTable, _children, _hadoop, _remove

OBSERVED = "clicks"
MOST_FILES = 64
_ROWS = "batch bigint, upto bigint, kind string, n bigint"


def report_table(path: str) -> StreamTable:
    return StreamTable(path, schemas.STREAM_REPORT, "added", ("kind",), None, 1)


class LifeReport(StreamingQueryListener):
    """Keeps the metrics that the batches of one query observe as ``OBSERVED``, and the clicks that a watermark has dropped, if it has one, as ``late``.

    Totals are right over restarts of the query. A batch counts once it is finished; one whose report is lost with the driver
    is missing, which ``batches`` among the kinds shows against the query's own numbers.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.last, self.seen = -1, threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.name is not None and progress.name != self.name:
            return
        counts = progress.observedMetrics.get(OBSERVED)
        if counts is not None and counts.asDict().get("read"):
            late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
            self._put(f"batch={progress.batchId}", {"batch": progress.batchId}, {**counts.asDict(), "late": late, "batches": 1})
            finished = [int(b) for b in _children(self.spark, self.path, "batch")]
            if len(finished) >= MOST_FILES:
                self._add_up(finished)
        with self.seen:
            self.last = max(self.last, progress.batchId)
            self.seen.notify_all()

    def _put(self, name: str, of: dict, counts: dict) -> None:
        path, files = _hadoop(self.spark, f"{self.path}/{name}")
        out = files.create(path, True)
        try:
            out.write(bytearray("".join(json.dumps({**of, "kind": kind, "n": n}) + "\n" for kind, n in counts.items()).encode()))
        finally:
            out.close()

    def _add_up(self, finished: list[int]) -> None:
        upto, before = max(finished), _children(self.spark, self.path, "upto")
        self._put(f"upto={upto}", {"upto": upto}, {r.kind: r.n for r in self.totals().collect()})
        for batch in finished:
            _remove(self.spark, f"{self.path}/batch={batch}")
        for old in before:
            _remove(self.spark, f"{self.path}/upto={old}")

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Waits until the last batch that the query has finished is in the report."""
        done = query.lastProgress
        if done is None:
            return True
        end = time.monotonic() + seconds
        with self.seen:
            while self.last < done.batchId and (left := end - time.monotonic()) > 0:
                self.seen.wait(left)
            return self.last >= done.batchId

    def totals(self) -> DataFrame:
        """Rows (kind, n). Files that the latest sum already holds, left by a failure in between, are not counted again."""
        known = max(map(int, _children(self.spark, self.path, "upto")), default=-1)
        if known < 0 and not _children(self.spark, self.path, "batch"):
            return self.spark.createDataFrame([], schemas.STREAM_REPORT)
        rows = self.spark.read.schema(_ROWS).json(f"{self.path}/*")
        return rows.where((F.col("upto") == known) | (F.col("batch") > known)).groupBy("kind").agg(F.sum("n").alias("n"))
