"""Partition writers through a client, and the report of a query's life."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from clickweave.sources import ad_lines
from clickweave.streaming import client, report
from clickweave.streaming.client import FolderClient
from tests.test_streaming import rows, write_files


class FailsOnce(FolderClient):
    """Fails on a marked row, until a file says that it has failed before."""

    def __init__(self, root, marker):
        super().__init__(root)
        self.marker = marker

    def send(self, rows_):
        super().send(rows_[:1])
        if any("bad" in row.value for row in rows_):
            try:
                with open(self.marker, "x"):
                    pass
            except FileExistsError:
                pass
            else:
                raise OSError("lost the connection")
        super().send(rows_[1:])


def written(root):
    found = Counter()
    for path in root.glob("epoch=*/*.json"):
        found.update(json.loads(line)["value"] for line in path.read_text().splitlines())
    return found


def test_a_failed_partition_is_written_once(spark, tmp_path):
    chunks = [[f"a{i}" for i in range(7)], ["good", "bad", "worse"], [f"b{i}" for i in range(5)]]
    source, target, marker = write_files(tmp_path / "in", chunks), tmp_path / "out", str(tmp_path / "failed")

    def run():
        lines = ad_lines.file_lines(spark, source)
        query = client.write_partitions(lines, lambda: FailsOnce(f"file://{target}", marker), str(tmp_path / "check"), available_now=True, bundle=2)
        query.awaitTermination(60)

    with pytest.raises(StreamingQueryException):
        run()
    before = written(target)
    assert before["good"] == before["bad"] == 0
    run()
    assert written(target) == Counter(v for chunk in chunks for v in chunk)
    names = {p: p.stat().st_mtime_ns for p in target.glob("epoch=*/*.json")}
    run()
    assert {p: p.stat().st_mtime_ns for p in target.glob("epoch=*/*.json")} == names and not list(target.glob("_drafts/*"))


def test_committed_partition_is_skipped(tmp_path):
    sent = client.PartitionWriter(lambda: FolderClient(f"file://{tmp_path}"), bundle=2)
    from pyspark.sql import Row
    for _ in range(2):
        if sent.open(3, 9):
            for i in range(5):
                sent.process(Row(value=str(i)))
        sent.close(None)
    assert written(tmp_path) == Counter(map(str, range(5)))


def test_life_report_over_150_batches_and_a_forced_stop(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "report"
    chunks = [[f"{i} 1 1 2 3", "unreadable"] for i in range(150)]

    def run(last):
        listener = report.LifeReport(spark, str(folder), "lived")
        spark.streams.addListener(listener)
        try:
            clicks = ad_lines.ad_parse(ad_lines.file_lines(spark, str(source), 1), report.OBSERVED)
            query = clicks.writeStream.queryName("lived").format("noop").option("checkpointLocation", str(tmp_path / "check")).start()
            for _ in range(600):
                if query.lastProgress and query.lastProgress.batchId >= last or query.awaitTermination(0.2):
                    break
            query.stop()
            assert listener.wait_for(query)
            return dict(rows(listener.totals())), listener.last + 1
        finally:
            spark.streams.removeListener(listener)

    write_files(source, chunks)
    totals, batches = run(149)
    assert batches == 150 and totals == {"read": 300, "accepted": 150, "rejected": 150, "late": 0, "batches": 150}
    write_files(source, chunks[:20], 150)
    totals, batches = run(155)
    assert 155 < batches <= 170
    assert totals == {"read": 2 * batches, "accepted": batches, "rejected": batches, "late": 0, "batches": batches}
    assert len(list(folder.glob("[bu]*"))) <= report.MOST_FILES + 1
