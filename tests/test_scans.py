"""Logs from their end, ledgers in SQLite, versions with conflicts, and streams that are replayed."""

import json
import sqlite3
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files, ledger, logs, versions
from lexmill.streaming import ingest

START = datetime(2024, 1, 1, tzinfo=UTC)


def _log(path, n, odd=True):
    lines = []
    for i in range(n):
        lines.append(json.dumps({"ts": (START + timedelta(minutes=i)).isoformat(), "kind": "warmup", "url": f"/{i}" + "x" * (i % 90)}))
        if odd and i % 7 == 0:
            lines += ["no json", "", json.dumps({"kind": "no stamp"}), json.dumps({"ts": "bad"}), "[1]"]
    path.write_text("\n".join(lines) + ("\n" if n % 2 else ""))


@pytest.mark.parametrize("block", [70, 1000, 1 << 20])
def test_look_back_reads_the_window(spark, tmp_path, block):
    _log(tmp_path / "events.jsonl", 500)
    for minutes in (0, 1, 250, 499, 10_000):
        cutoff = START + timedelta(minutes=500 - minutes)
        found = logs.look_back(spark, str(tmp_path / "events.jsonl"), cutoff, block=block).collect()
        assert sorted(int(r.url.strip("/x")) for r in found) == list(range(max(500 - minutes, 0), 500))


def test_blocks_fall_with_the_window(spark, tmp_path):
    _log(tmp_path / "events.jsonl", 5000, odd=False)
    blocks = lambda minutes: len(logs._Reader({"path": str(tmp_path), "cutoff": (START + timedelta(minutes=5000 - minutes)).isoformat(), "block": 4096}).partitions())
    assert blocks(10) <= 2 < blocks(1000) < blocks(4000) < blocks(5001)
    assert logs._Reader({"path": str(tmp_path), "cutoff": datetime.now(UTC).replace(year=2100).isoformat()}).partitions() == []
    assert logs.look_back(spark, str(tmp_path / "absent"), START).count() == 0


def test_lines_belong_to_one_block(tmp_path):
    text = b"first\n\nlonger line than a block\nx\n" + b"y" * 70 + b"\nlast"
    (tmp_path / "l").write_bytes(text)
    for step in range(1, len(text) + 2):
        with open(tmp_path / "l", "rb") as file:
            pieces = [p for start in range(0, len(text), step) for p in logs._pieces(file, start, min(start + step, len(text)))]
        assert b"".join(pieces) == text


def test_tail_of_a_log(spark, tmp_path):
    path = tmp_path / "scrape.log"
    path.write_text("\n".join(f"line {i} " + "z" * 300 for i in range(2000)) + "\n")
    assert [r.line.split()[1] for r in logs.tail(spark, str(path), 200).orderBy("position").collect()] == [str(i) for i in range(1800, 2000)]
    path.write_text("only")
    assert [r.line for r in logs.tail(spark, str(path), 200).collect()] == ["only"]
    path.write_text("")
    assert logs.tail(spark, str(path), 200).count() == 0


def _ledger(path, rows=1000):
    with sqlite3.connect(path) as db:
        db.execute("create table cases (number integer primary key, status text, seen real)")
        db.executemany("insert into cases values (?, ?, ?)", [(i, [None, "pending", "failed"][i % 3], i / 2) for i in range(rows)])
        db.execute("create table keyed (k text primary key, n integer) without rowid")
        db.execute("insert into keyed values ('a', 1), ('b', null)")
        db.execute("pragma user_version = 4")
    db.close()


def test_ledger_ranges_filters_and_columns(spark, tmp_path):
    path = str(tmp_path / "l.db")
    _ledger(path)
    rows = ledger.ledger(spark, path, "cases", partitions=5)
    assert rows.dtypes == [("number", "bigint"), ("status", "string"), ("seen", "double")]
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 1000
    count = lambda *where: ledger.ledger(spark, path, "cases", where=where, partitions=3).count()
    assert count(("status", "=", "failed"), ("number", ">=", 990)) == 3 and count(("status", "is null")) == 334 and count(("status", "<>", "failed")) == 333
    assert count(("number", "in", [1, 2, 5000])) == 2 and count() == 1000
    failed = rows.where("status = 'failed'").count()
    assert (failed, rows.count()) == (333, 1000)  # nothing stays with the frame
    with pytest.raises(ValueError, match="unknown relation"):
        count(("status", "like", "x"))
    assert ledger.ledger(spark, path, "cases", "status string, later bigint", where=[("later", "is null")], partitions=2).count() == 1000
    assert sorted(tuple(r) for r in ledger.ledger(spark, path, "keyed").collect()) == [("a", 1), ("b", None)]
    reader = ledger._Reader(rows.schema, {"path": path, "table": "cases", "where": json.dumps([["status", "=", "failed"], ["number", "in", [1, 2, 5]]])})
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(2, "failed", 1.0), (5, "failed", 2.5)]


def test_ledger_absent_corrupt_old_or_changing(spark, tmp_path):
    path = str(tmp_path / "l.db")
    assert ledger.ledger(spark, path, "cases", "number bigint").count() == 0
    _ledger(path)
    with pytest.raises(Exception, match="schema version 4, not 5"):
        ledger.ledger(spark, path, "cases", version=5).count()
    reader = ledger._Reader(ledger.ledger(spark, path, "cases").schema, {"path": path, "table": "cases", "partitions": "4"})
    parts = reader.partitions()
    with sqlite3.connect(path) as db:
        db.execute("insert into cases values (5000, 'x', 1)")
    db.close()
    with pytest.raises(RuntimeError, match="changed while it was read"):
        list(reader.read(parts[0]))
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:4096] + b"\xff" * 4096 + whole[8192:])
    with pytest.raises(Exception, match="integrity check|malformed"):
        ledger.ledger(spark, path, "cases", "number bigint").count()
    with pytest.raises(ValueError, match="a disk that all executors mount"):
        ledger.local_path("hdfs://x/l.db")


def test_versions_conflict(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    first = versions.publish(spark.range(1), path, base=0)
    second = versions.publish(spark.range(2), path, base=first.number)
    with pytest.raises(versions.Conflict, match=second.folder) as caught:
        versions.publish(spark.range(9), path, base=first.number)
    assert caught.value.other == second and versions.current(spark, path).count() == 2 and versions.current(spark, path, 1).count() == 1
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    versions.forget(spark, path, keep=1)
    assert versions.numbers(spark, path) == [2] and versions.current(spark, path).count() == 2


def test_one_of_many_writers_wins_and_readers_always_read(spark, tmp_path):
    path, won, lost, seen, done = f"file://{tmp_path}/t", [], [], [], threading.Event()
    versions.publish(spark.range(1), path)

    def write(n):
        try:
            won.append(versions.publish(spark.range(n), path, base=1))
        except versions.Conflict as conflict:
            lost.append(conflict.other)

    def read():
        while not done.is_set():
            seen.append(versions.latest(spark, path).number)

    threads, reader = [threading.Thread(target=write, args=(n,)) for n in range(2, 6)], threading.Thread(target=read)
    reader.start()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    done.set()
    reader.join()
    assert len(won) == 1 and lost == won * 3 and set(seen) <= {1, 2} and seen == sorted(seen)


def test_replayed_runs_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    state, crash = f"file://{tmp_path}/state", [True]
    stream = lambda: spark.readStream.schema("k string, n bigint").json(str(tmp_path / "in"))

    def merge(old, batch):
        new = batch.groupBy("k").agg(F.sum("n").alias("n"))
        return new if old is None else old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    def run():
        ingest.ingest_into(stream(), state, merge, str(tmp_path / "log")).awaitTermination()

    (tmp_path / "in" / "0.json").write_text('{"k": "a", "n": 1}')
    run()
    (tmp_path / "in" / "1.json").write_text('{"k": "a", "n": 5}')
    whole = versions.publish
    try:  # the run's version is committed, and then the run fails before its own log says so
        def publish(*args, **named):
            out = whole(*args, **named)
            if crash.pop():
                raise RuntimeError("lost")
            return out

        versions.publish = publish
        with pytest.raises(Exception, match="lost"):
            run()
    finally:
        versions.publish = whole
    run()
    assert [tuple(r) for r in versions.current(spark, state).collect()] == [("a", 6)] and versions.numbers(spark, state) == [1, 2]


def test_overlapping_logs_give_each_event_once(spark, tmp_path):
    write = lambda name, ids: (tmp_path / "in" / name).write_text("".join(json.dumps({"event_id": i, "ts": f"2024-01-01T00:{i:02d}:00Z"}) + "\n" for i in ids))
    (tmp_path / "in").mkdir()
    for name, ids in (("0.json", range(30)), ("1.json", range(20, 50))):
        write(name, ids)
        stream = spark.readStream.schema("event_id bigint, ts timestamp").json(str(tmp_path / "in"))
        ingest.appended(stream, "event_id", str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))


def test_appended_events_keep_microseconds(spark, tmp_path):
    when = datetime(2024, 1, 1, 1, 2, 3, 456789)
    files.append_events(spark.createDataFrame([(when, "warmup")], "ts timestamp, kind string"), str(tmp_path / "log"))
    assert files.event_log(spark, str(tmp_path / "log")).first().ts == when
