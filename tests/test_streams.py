"""Streams with stored state: two micro-batches and a restart each."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from tests.conftest import rows

from keyfathom.operators import runtime
from keyfathom.streaming import events, hosts, levels
from keyfathom.streaming import runtime as stream

T0 = dt.datetime(2024, 1, 1)
NOW = {"availableNow": True}


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def add(spark, path: Path, schema: str, *given: tuple):
    spark.createDataFrame(list(given), schema).coalesce(1).write.mode("append").parquet(str(path))


def uncommit(checkpoint: Path):
    """The state after a crash between the writing of the last batch and its commit."""
    commit = sorted((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    commit.unlink()
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)


REPORTS = "host_id string, received_at timestamp, hostname string, agent_version string, kernel_info string"


def test_hosts(spark, tmp_path):
    path, out = tmp_path / "in", str(tmp_path / "out")

    def go():
        reports = spark.readStream.schema(REPORTS).parquet(str(path))
        hosts.host_stream(reports, out, str(tmp_path / "cp"), 60, "10 seconds", NOW).awaitTermination()
        return {r.host_id: (r.hostname, r.agent_version, r.kernel_info, r.last_seen_at, r.status)
                for r in hosts.current_hosts(spark, out).collect()}

    add(spark, path, REPORTS, ("a", at(0), "first", "1.0", None), ("a", at(5), "", "1.1", "k"), ("b", at(0), "b", None, None),
        (None, at(1), "x", None, None), ("z", None, "z", None, None))
    assert go() == {"a": ("first", "1.1", "k", at(5), "alive"), "b": ("b", None, None, at(0), "alive")}
    # after a restart: a late report of a, which changes only what is not newer already, and a jump of time
    add(spark, path, REPORTS, ("a", at(2), "second", "0.9", "old"), ("c", at(200), "c", "2", "k"))
    assert go() == {"a": ("second", "1.1", "k", at(5), "silent"), "b": ("b", None, None, at(0), "silent"),
                    "c": ("c", "2", "k", at(200), "alive")}
    add(spark, path, REPORTS, ("b", at(210), None, "3", None))
    assert go()["b"] == ("b", "3", None, at(210), "alive")
    batch = {r.host_id: tuple(r)[1:] for r in runtime.heartbeats(spark.read.parquet(str(path)).where("host_id IS NOT NULL")).collect()}
    assert {h: v[:4] for h, v in go().items()} == {h: batch[h] for h in "abc"}


DELIVERIES = "delivery_id string, repo_id string, provider string, event_type string, body string, received_at timestamp"


def test_webhooks(spark, table, tmp_path):
    path, out = tmp_path / "in", str(tmp_path / "out")
    versions = [table("repo_id string, branch string", ("r", "main")), table("repo_id string, branch string", ("r", "dev"))]
    asked = []

    def repos_at(batch_id):
        asked.append(batch_id)
        return versions[min(batch_id, 1)]

    def push(key, branch, seconds):
        return (key, "r", "github", "push", f'{{"ref":"refs/heads/{branch}","after":"{key}"}}', at(seconds))

    def go():
        deliveries = spark.readStream.schema(DELIVERIES).parquet(str(path))
        events.queue_scans(deliveries, repos_at, out, str(tmp_path / "cp"), "1 hour", NOW).awaitTermination()
        return rows(spark.read.parquet(out), "delivery_id", "branch", "status")

    add(spark, path, DELIVERIES, push("1", "main", 0), push("2", "dev", 1), push("1", "main", 2))
    first = [("1", "main", "scan_queued"), ("2", "dev", "ignored")]
    assert go() == first
    uncommit(tmp_path / "cp")
    assert go() == first
    add(spark, path, DELIVERIES, push("2", "dev", 30), push("3", "dev", 31), push("4", "main", 32))
    assert go() == [*first, ("3", "dev", "scan_queued"), ("4", "main", "ignored")]
    assert len(set(asked)) < len(asked)


FOUND = ("host_id string, algorithm string, symbol string, process_name string, pid long, library string, occurrences long, "
         "first_seen timestamp, last_seen timestamp")


def report(n, host="h", library="lib", seconds=None):
    when = at(n if seconds is None else seconds)
    return (host, "MD5", "MD5_Init", None, 1, library, n, when, when)


def test_levels_of_runs():
    for fanout in (2, 3, 8):
        there = set()
        for n in range(200):
            there.add((0, n, n))
            for run, parts in levels.merges_after(n, fanout):
                assert len(parts) == fanout and all(p in there for p in parts)
                assert (parts[0][1], parts[-1][2]) == run[1:]
                there.add(run)
            runs = levels.runs_after(n, fanout)
            assert all(r in there for r in runs) and [r[1] for r in runs] == [0, *[r[2] + 1 for r in runs[:-1]]]
            assert runs[-1][2] == n and all(sum(r[0] == k for r in runs) < fanout for k in range(9))


def test_a_compaction_reads_the_last_level_only(spark, table, tmp_path, monkeypatch):
    path, read = str(tmp_path / "state"), []
    plain = levels.read_runs
    monkeypatch.setattr(levels, "read_runs", lambda spark, path, runs: read.append(runs) or plain(spark, path, runs))
    expected = []
    for n in range(9):
        batch = [report(n), report(2 * n, "g", None if n % 2 else f"lib{n}", 100 - n)]
        expected += [(*b, n) for b in batch]
        levels.add_batch(table(FOUND, *batch), n, path, 3)
    merges = [runs for runs in read]
    assert [len(runs) for runs in merges] == [3, 3, 3, 3] and [runs[0][0] for runs in merges] == [0, 0, 0, 1]
    files = plain(spark, path, merges[-1]).inputFiles()
    assert files and all("/level=1/" in f for f in files)
    whole = runtime.upsert(table(FOUND), table(FOUND + ", seq long", *expected))
    assert levels.current_runs(spark, path) == [(2, 0, 8)]
    assert rows(levels.current_findings(spark, path).select(whole.columns)) == rows(whole)
    levels.add_batch(table(FOUND, report(50)), 9, path, 3)
    before = rows(levels.current_findings(spark, path))
    levels.add_batch(table(FOUND, report(50)), 9, path, 3)  # run again
    levels.add_batch(table(FOUND, report(8), report(16, "g", "lib8", 92)), 8, path, 3)  # and the one with the merges
    levels.add_batch(table(FOUND, report(50)), 9, path, 3)
    assert rows(levels.current_findings(spark, path)) == before and levels.current_runs(spark, path) == [(2, 0, 8), (0, 9, 9)]
    assert levels.vacuum(spark, path) > 10
    assert rows(levels.current_findings(spark, path)) == before and levels.vacuum(spark, path) == 0


def test_levelled_stream(spark, tmp_path):
    path, out = tmp_path / "in", str(tmp_path / "out")

    def go():
        incoming = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(str(path))
        levels.upsert_stream(incoming, out, str(tmp_path / "cp"), 2, NOW).awaitTermination()
        return rows(levels.current_findings(spark, out), "occurrences", "first_seen", "library")

    for n in (5, 1, 3):
        add(spark, path, FOUND, report(n))
    assert go() == [(9, at(1), "lib")]
    add(spark, path, FOUND, report(4, library=""))
    assert go() == [(13, at(1), "lib")] and levels.current_runs(spark, out) == [(2, 0, 3)]
    uncommit(tmp_path / "cp")
    assert go() == [(13, at(1), "lib")] and levels.current_runs(spark, out) == [(2, 0, 3)]


EVENTS = "host_id string, ts timestamp, pid long, probe_id long, comm string"


def test_late_rows_are_counted(spark, tmp_path):
    path = tmp_path / "in"

    def go():
        windows = stream.windowed_calls(spark.readStream.schema(EVENTS).parquet(str(path)), delay="1 minute")
        query = stream.append_windows(windows, str(tmp_path / "out"), str(tmp_path / "cp"), NOW)
        query.awaitTermination()
        return stream.dropped_late(query), rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "occurrences")

    add(spark, path, EVENTS, *[("h", at(s), 1, 0, "c") for s in (1, 2, 200)])
    assert go() == (0, [(T0, 2)])
    add(spark, path, EVENTS, *[("h", at(s), 1, 0, "c") for s in (3, 4, 201, 400)])
    assert go() == (1, [(T0, 2), (at(180), 2)])  # two rows of one window and key
