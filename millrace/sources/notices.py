"""An outbox for notices: a sink of rows in parts that count only once committed.

``df.write.format("notices").option("path", folder).option("batch", n)`` and ``writeStream.format("notices")``
write rows as JSON lines, ``rows`` (200) to a part, as the body of one call would hold them.  No
task sees more than its own rows.  A batch's commit names its parts in one small file; parts of a
batch that failed are deleted (those of tasks that died by :meth:`Outbox.sweep`), and a batch that was
committed before and is run again adds nothing.
Whoever sends reads committed parts only, and marks as told what :func:`receipts` returns.

The folder must be one that driver and executors share: a mounted path or a store that Arrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as store
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..operators.state import upsert_notified

ROWS = 200


@dataclass
class Parts(WriterCommitMessage):
    files: list[str]


class Outbox:
    def __init__(self, path: str) -> None:
        if path.startswith("file:/") and not path.startswith("file://"):
            path = path.removeprefix("file:")
        self.fs, self.root = store.FileSystem.from_uri(path)

    def write(self, name: str, text: str) -> None:
        self.fs.create_dir(f"{self.root}/{name.rpartition('/')[0]}", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(text.encode())

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type != store.FileType.NotFound

    def delete(self, files: list[str]) -> None:
        for f in files:
            if self.exists(f):
                self.fs.delete_file(f"{self.root}/{f}")

    def write_rows(self, rows: Iterator[Row], most: int) -> Parts:
        files, held = [], []

        def flush() -> None:
            files.append(f"parts/{uuid.uuid4().hex}.json")
            self.write(files[-1], "\n".join(held) + "\n")
            held.clear()

        try:
            for row in rows:
                held.append(json.dumps(row.asDict(True), ensure_ascii=False, default=str))
                if len(held) >= most:
                    flush()
            if held:
                flush()
        except BaseException:
            self.delete(files)
            raise
        return Parts(files)

    def commit(self, messages: list[Parts | None], batch: int) -> None:
        files, name = [f for m in messages if m for f in m.files], f"commits/{batch:012d}.json"
        if self.exists(name):
            self.delete(files)
            return
        temporary = f"commits/.{uuid.uuid4().hex}"
        self.write(temporary, json.dumps(files))
        self.fs.move(f"{self.root}/{temporary}", f"{self.root}/{name}")

    def committed(self, since: int = 0) -> list[str]:
        """Parts of the batches from ``since`` on: names, as many as calls to be made."""
        found = self.fs.get_file_info(store.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and int(f.base_name.removesuffix(".json")) >= since)
        out: list[str] = []
        for n in names:
            with self.fs.open_input_stream(f"{self.root}/commits/{n}") as f:
                out += json.loads(f.read())
        return out

    def sweep(self) -> int:
        """Delete parts that no commit names; to be called while no batch is being written."""
        named = set(self.committed())
        found = self.fs.get_file_info(store.FileSelector(f"{self.root}/parts", allow_not_found=True))
        lost = [f"parts/{f.base_name}" for f in found if f"parts/{f.base_name}" not in named]
        self.delete(lost)
        return len(lost)


class _Writer:
    def __init__(self, options: dict) -> None:
        self.path, self.rows, self.batch = options["path"], int(options.get("rows", ROWS)), int(options.get("batch", 0))

    def write(self, iterator: Iterator[Row]) -> Parts:
        return Outbox(self.path).write_rows(iterator, self.rows)


class NoticeWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        Outbox(self.path).commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        Outbox(self.path).delete([f for m in messages if m for f in m.files])


class NoticeStreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  the interface's name
        Outbox(self.path).commit(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        Outbox(self.path).delete([f for m in messages if m for f in m.files])


class Notices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notices"

    def writer(self, schema, overwrite: bool) -> NoticeWriter:
        return NoticeWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> NoticeStreamWriter:  # noqa: N802  the interface's name
        return NoticeStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Notices)


def receipts(spark: SparkSession, path: str, schema: str = "fingerprint string", since: int = 0) -> DataFrame:
    """Rows of the parts that were committed."""
    files = Outbox(path).committed(since)
    root = path.rstrip("/")
    return spark.read.schema(schema).json([f"{root}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def notify(picks: DataFrame, path: str, batch: int, ledger) -> int:
    """Put a run's picks in the outbox and, once they are committed, mark them in the ledger (a bucket
    table); its new version.  What fails before that marks nothing and may be run again."""
    spark = picks.sparkSession
    register(spark)
    picks.write.format("notices").option("path", path).option("batch", batch).mode("append").save()
    return upsert_notified(ledger, receipts(spark, path, since=batch))
