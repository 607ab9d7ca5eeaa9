"""A streaming sink of text files that count only once a batch's manifest names them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from harborline.sources.tasklog import _open

MANIFESTS = "_manifests"


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its file, if it had rows, and how many."""

    file: str
    rows: int


class ManifestWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, column: str):
        self.folder, self.column = folder, column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of this try of this task, in a file of its own."""
        files, root = _open(self.folder)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{root}/rows", recursive=True)
        with files.open_output_stream(f"{root}/rows/{name}") as stream:
            for batch in iterator:
                for line in batch.column(self.column).to_pylist():
                    stream.write((line or "").encode() + b"\n")
                    rows += 1
        if not rows:
            files.delete_file(f"{root}/rows/{name}")
        return Written(name, rows)

    def _drop(self, messages: list) -> None:
        files, root = _open(self.folder)
        for message in messages:
            if message is not None and message.rows:
                files.delete_file(f"{root}/rows/{message.file}")

    def commit(self, messages: list, batchId: int) -> None:
        """One manifest names all files of the batch. A batch that has one already was written before: it stays."""
        files, root = _open(self.folder)
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        path = f"{root}/{MANIFESTS}/{batchId:012d}.json"
        if files.get_file_info(path).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        named = {"batch": batchId, "files": {m.file: m.rows for m in messages if m is not None and m.rows}}
        with files.open_output_stream(path + ".new") as stream:
            stream.write(json.dumps(named).encode())
        files.move(path + ".new", path)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class ManifestSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifest_text"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], schema.fieldNames()[0])


def manifest_writer(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write a stream of one string column (JSON documents, payloads) as lines, each batch whole and once.

    Every try of a task writes a file of its own; the driver collects their names and replaces one manifest a batch as a
    whole. What no manifest names, because its task was killed or its batch failed, does not count, and a
    batch that is run again after its manifest stands leaves that as it is. Readers use `read_manifested`.
    """
    lines.sparkSession.dataSource.register(ManifestSink)
    return lines.writeStream.format("manifest_text").option("path", path).option("checkpointLocation", checkpoint)


def read_manifested(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of all batches that have a manifest."""
    files, root = _open(path)
    folder = f"{root}/{MANIFESTS}"
    names: list[str] = []
    if files.get_file_info(folder).type == fs.FileType.Directory:
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name.endswith(".json"):
                with files.open_input_stream(info.path) as stream:
                    names += json.loads(stream.read())["files"]
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.read.text([f"{path}/rows/{name}" for name in sorted(names)])
