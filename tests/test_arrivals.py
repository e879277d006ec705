"""Streams of message files take them from lists that tasks write: whole, once, and without their names in the driver."""

import glob
import os
import threading
import time

from conftest import SF001
from mailsift.session import checkpoint_root, scratch_path
from mailsift.sources.eml import follow_arrivals, list_arrivals, stream_messages


def _write(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else name.encode())


def _started(stream, out, checkpoint, **trigger):
    return stream.select("path", "length", "content").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _taken(spark, out):
    return sorted((r.path.rpartition("/")[2], bytes(r.content).decode()) for r in spark.read.parquet(out).collect())


def _expected(names):
    return sorted((n.rpartition("/")[2], n) for n in names)


def test_the_checkpoint_of_a_message_stream_names_lists_only(spark, tmp_path):
    """The source log is what the driver holds of a stream's files: as many names as lists, not as messages."""
    names = [f"{i % 7}/{i}.eml" for i in range(300)]
    _write(tmp_path / "in", names)
    out, checkpoint = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
    query = _started(stream_messages(spark, str(tmp_path / "in"), max_files_per_trigger=120), out, checkpoint, availableNow=True)
    query.awaitTermination()
    assert _taken(spark, out) == _expected(names)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(sizes) == 300 and max(sizes) <= 120
    folder = f"{checkpoint.removeprefix('file:')}/sources/0"
    logged = [x for f in os.listdir(folder) if not f.startswith(".") for x in open(f"{folder}/{f}").read().splitlines() if "path" in x]
    assert 3 <= len(logged) <= 6 and not any(".eml" in x for x in logged)


def test_a_stream_started_again_takes_what_came_since(spark, tmp_path):
    root = str(tmp_path / "in")
    first, second = ["a.eml", "x/b.eml", "x/empty.eml", "_h/c.eml", "x/d.txt"], ["e.eml", "x/y/f.eml", "k=_1/g.eml"]
    out, checkpoint, log = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt"), scratch_path(spark, "t-log")
    for names in (first, second):
        _write(tmp_path / "in", names)
        _started(stream_messages(spark, root, log=log), out, checkpoint, availableNow=True).awaitTermination()
    assert _taken(spark, out) == _expected(["a.eml", "x/b.eml", *second])
    lists = sorted(os.listdir(log))
    assert list_arrivals(spark, root, log) == 0 and sorted(os.listdir(log)) == lists


def test_a_running_stream_is_followed(spark, tmp_path):
    root, log = str(tmp_path / "in"), scratch_path(spark, "t-log")
    (tmp_path / "in").mkdir()
    out, checkpoint = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
    query = _started(stream_messages(spark, root, log=log), out, checkpoint, processingTime="200 milliseconds")
    following = threading.Thread(target=follow_arrivals, args=(query, spark, root, log), kwargs={"every": 0.5})
    following.start()
    try:
        _write(tmp_path / "in", ["a.eml", "x/b.eml"])
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < 2:
            time.sleep(0.2)
        query.processAllAvailable()
    finally:
        query.stop()
        following.join(60)
    assert not following.is_alive() and _taken(spark, out) == _expected(["a.eml", "x/b.eml"])


def test_the_funnel_of_messages_names_lists_only(spark):
    from mailsift.plans.q_stream import stream_message_funnel
    logs = f"{checkpoint_root(spark).removeprefix('file:')}/message-funnel-ckpt-*/sources/0/[0-9]*"
    before = set(glob.glob(logs))
    got = {r.outcome: r.n for r in stream_message_funnel(spark, SF001).collect()}
    documents, bench = (spark.read.parquet(f"{SF001}/{t}.parquet").count() for t in ("documents", "benchmark"))
    assert got["found"] == documents + 3 * bench == sum(n for o, n in got.items() if o != "found") and got["parse_error"] == bench
    logged = "".join(open(f).read() for f in set(glob.glob(logs)) - before)
    assert "path" in logged and ".eml" not in logged


def test_a_plan_has_the_table_of_references_once_a_call(spark):
    """Each copy is a literal of 2,231 names, which the driver makes anew for every micro-batch."""
    from mailsift.functions.html import unescape
    plan = spark.createDataFrame([("a &amp; &notit; &#65; &&lt", )], "x string").select(unescape("x").alias("y"))
    assert plan._jdf.queryExecution().analyzed().toString().count("from_json") == 1
    assert plan.first().y == "a & \u00acit; A &<"
