"""Rows of a stream written partition by partition through a client of the target.

``PartitionWriter`` is the writer of ``writeStream.foreach``: for every partition of a batch it opens a client, hands it the rows in bundles and
commits them together with the partition's and the batch's number. A partition that the target has already committed for a batch is
skipped, so after a failure, when Spark runs the batch again, each row is in the target once. That needs a source that gives a repeated
batch the same rows in the same partitions, which files and Kafka do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery

from clickweave.plans.shared import shared_folder

BUNDLE = 1000


class Client(Protocol):
    """A connection to the target; one is opened per partition and batch, on an executor."""

    def committed(self, partition: int, epoch: int) -> bool:
        """Whether the target already has this partition of this batch."""

    def send(self, rows: Sequence[Row]) -> None:
        """Rows that must not be seen by others before ``commit``."""

    def commit(self, partition: int, epoch: int) -> None:
        """Makes all rows sent visible and remembers the partition and the batch, in one step."""

    def close(self) -> None: ...


class PartitionWriter:
    def __init__(self, connect: Callable[[], Client], bundle: int = BUNDLE):
        self.connect, self.bundle = connect, bundle

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.place, self.rows = (partition_id, epoch_id), []
        self.client = self.connect()
        return not self.client.committed(*self.place)

    def process(self, row: Row) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.bundle:
            self._send()

    def close(self, error: Exception | None) -> None:
        try:
            if error is None and not self.client.committed(*self.place):
                self._send()
                self.client.commit(*self.place)
        finally:
            self.client.close()

    def _send(self) -> None:
        if self.rows:
            self.client.send(self.rows)
            self.rows = []


class FolderClient:
    """JSON lines below a folder that all executors share, a file for each partition of a batch; the file's name is the commit.

    Bundles go to the file system as they come; a file gets its name when it is whole.
    """

    def __init__(self, root: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(root)
        self.out = None

    def _name(self, partition: int, epoch: int) -> str:
        return f"{self.root}/epoch={epoch}/part-{partition:05d}.json"

    def committed(self, partition: int, epoch: int) -> bool:
        return self.files.get_file_info(self._name(partition, epoch)).is_file

    def send(self, rows: Sequence[Row]) -> None:
        if self.out is None:
            import uuid

            self.draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
            self.files.create_dir(f"{self.root}/_drafts")
            self.out = self.files.open_output_stream(self.draft)
        self.out.write("".join(json.dumps(row.asDict(), default=str) + "\n" for row in rows).encode())

    def commit(self, partition: int, epoch: int) -> None:
        if self.out is None:  # no rows: an empty file says that the partition is done
            self.send([])
        self.out.close()
        self.out = None
        self.files.create_dir(f"{self.root}/epoch={epoch}")
        self.files.move(self.draft, self._name(partition, epoch))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.delete_file(self.draft)


def write_partitions(rows: DataFrame, connect: Callable[[], Client], checkpoint: str | None = None, available_now: bool = False,
                     interval: str = "5 seconds", output_mode: str = "append", bundle: int = BUNDLE) -> StreamingQuery:
    """Starts a query that writes every batch through clients on the executors."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return rows.writeStream.outputMode(output_mode).foreach(PartitionWriter(connect, bundle)).option(
        "checkpointLocation", shared_folder(rows.sparkSession, checkpoint, "partitions")).trigger(**trigger).start()
