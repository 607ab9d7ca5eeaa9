"""A log of task messages in a shared folder as a stream source with offsets, a bound on the work in flight and commits."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Fixed value: messages a consumer may have in hand before they are acknowledged.
PREFETCH = 100
MESSAGE = "body string, segment string, place long"
BLOCK = 1 << 20
ROWS = 2000


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


def _lines(files: fs.FileSystem, path: str, at: int = 0) -> Iterator[bytes]:
    """Whole lines only, from byte `at`: what a writer has not ended with a newline is not there yet."""
    rest = b""
    with files.open_input_file(path) as stream:
        stream.seek(at)
        while block := stream.read(BLOCK):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines


class Range(InputPartition):
    """Lines `begin` to `end` of a segment; the first of them is at byte `at`."""

    def __init__(self, segment: str, begin: int, end: int, at: int = 0):
        self.segment, self.begin, self.end, self.at = segment, begin, end, at


class TaskLogReader(DataSourceStreamReader):
    """Offsets are (segment, line): all lines of earlier segments, by name, and so many of this one."""

    def __init__(self, folder: str, prefetch: int, group: str):
        self.folder, self.prefetch, self.group = folder, prefetch, group
        self.planned = None  # how far batches have been planned by this reader
        # Bytes where lines begin, by segment and line: of offsets that are not committed yet.
        self.places: dict[tuple[str, int], int] = {}

    def _segments(self) -> list[str]:
        files, root = _open(self.folder)
        names = [f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
        return sorted(n for n in names if n[0] not in "._")

    def _place(self, files: fs.FileSystem, root: str, segment: str, line: int) -> int:
        """The byte where a line begins; lines before it are read only once after a restart."""
        known = self.places.get((segment, line))
        if known is None:
            known = sum(len(x) + 1 for x in islice(_lines(files, f"{root}/{segment}"), line))
            self.places[segment, line] = known
        return known

    def _ranges(self, start: dict, most: int | None, stop: dict | None = None) -> Iterator[Range]:
        """Ranges of lines from `start`, in order: at most `most` lines, up to `stop`."""
        files, root = _open(self.folder)
        for segment in self._segments():
            if segment < start["segment"] or (stop and segment > stop["segment"]):
                continue
            begin = start["line"] if segment == start["segment"] else 0
            at = self._place(files, root, segment, begin) if begin else 0
            if stop and segment == stop["segment"]:
                end = stop["line"]
            else:
                end, after = begin, at
                for line in islice(_lines(files, f"{root}/{segment}", at), most):
                    end += 1
                    after += len(line) + 1
                self.places[segment, end] = after
                if most is not None:
                    most -= end - begin
            if end > begin:
                yield Range(segment, begin, end, at)
            if most == 0:
                return

    def initialOffset(self) -> dict:
        return {"segment": "", "line": 0}

    def latestOffset(self) -> dict:
        """At most `prefetch` messages beyond what was planned before."""
        at = self.planned or self._restored() or self.initialOffset()
        for found in self._ranges(at, self.prefetch):
            at = {"segment": found.segment, "line": found.end}
        self.planned = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # A restarted query runs its last batch again first: what comes next follows that.
        self.planned = max(self.planned or end, end, key=lambda o: (o["segment"], o["line"]))
        return list(self._ranges(start, None, end))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, root = _open(self.folder)
        rows: list[tuple[str, str, int]] = []
        lines = _lines(files, f"{root}/{partition.segment}", partition.at)
        for i, line in zip(range(partition.begin, partition.end), lines):
            rows.append((line.decode("utf-8", "replace"), partition.segment, i))
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        bodies, segments, places = zip(*rows)
        columns = [pa.array(bodies, pa.string()), pa.array(segments, pa.string()), pa.array(places, pa.int64())]
        return pa.record_batch(columns, names=["body", "segment", "place"])

    def _mark(self) -> tuple[fs.FileSystem, str]:
        files, root = _open(self.folder)
        return files, f"{root}/_committed-{self.group}"

    def _restored(self) -> dict | None:
        files, path = self._mark()
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def commit(self, end: dict) -> None:
        """Acknowledge: all before `end` is done with. The mark is replaced as a whole."""
        files, path = self._mark()
        with files.open_output_stream(path + ".new") as stream:
            stream.write(json.dumps(end).encode())
        files.move(path + ".new", path)
        done = (end["segment"], end["line"])
        self.places = {k: v for k, v in self.places.items() if k >= done}

    def stop(self) -> None:
        pass


class TaskLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "task_log"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema: StructType) -> TaskLogReader:
        options = self.options
        return TaskLogReader(options["path"], int(options.get("prefetch", PREFETCH)), options.get("group", "tasks"))


def task_log(spark: SparkSession, folder: str, prefetch: int = PREFETCH, group: str = "tasks") -> DataFrame:
    """Task messages of a log as a stream: body, and segment and place, which tell deliveries apart.

    The log is a folder of text files, taken by name, to which writers append lines and further files; names
    must rise. A batch has at most `prefetch` messages, split by segment over the tasks. The
    query's checkpoint holds its offsets: after a crash the batch in hand is read again, from the same lines, and goes on
    after it, so with an idempotent sink or `dedupe_deliveries` each message counts once. When a batch is done, `group`'s mark in
    the folder moves on; it tells writers what may be removed, and where a query without a checkpoint begins its batches.

    A line without a newline at its end is not there yet; an empty one is a message with an empty body, thus malformed.
    """
    spark.dataSource.register(TaskLog)
    return spark.readStream.format("task_log").option("prefetch", prefetch).option("group", group).load(folder)
