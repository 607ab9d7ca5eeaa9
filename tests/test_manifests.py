"""The sink with manifests: batches whole and once, whatever failed on the way."""

import json
import os

import pyarrow as pa

from harborline.sources.manifests import ManifestWriter, manifest_writer, read_manifested
from harborline.streaming import streams

from .test_streams import feed  # noqa: F401  (a fixture)


def lines(*values):
    return iter([pa.record_batch({"json": pa.array(values, pa.string())})])


def test_killed_tasks_and_replayed_batches_leave_one_copy(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = ManifestWriter(out, "json")
    writer.write(lines("a", "b"))  # its task was killed: nobody hears of this file
    first = [writer.write(lines("a", "b")), writer.write(lines("c")), writer.write(iter([]))]
    assert read_manifested(spark, out).count() == 0
    writer.commit(first, 0)
    again = [writer.write(lines("a", "b", "c"))]
    writer.commit(again, 0)  # the query died before it noted the batch, and ran it again
    failed = [writer.write(lines("x")), None]
    writer.abort(failed, 1)
    writer.commit([writer.write(lines("d", None))], 1)
    assert sorted(r.value for r in read_manifested(spark, out).collect()) == ["", "a", "b", "c", "d"]
    assert len(os.listdir(f"{out}/rows")) == 4  # with the killed task's


def test_stream_into_manifests(spark, feed, tmp_path):  # noqa: F811
    def batch(*values):
        return spark.createDataFrame([(v,) for v in values], "json string")

    out = f"{tmp_path}/out"
    stream = feed(batch('{"a":1}', '{"a":2}'), batch('{"a":3}'))
    streams.run_to_end(manifest_writer(stream, out, f"{tmp_path}/cp"))
    assert sorted(json.loads(r.value)["a"] for r in read_manifested(spark, out).collect()) == [1, 2, 3]
    assert len([f for f in os.listdir(f"{out}/_manifests") if f.endswith(".json")]) == 2
