from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from tests.conftest import rows
from pyspark.sql import functions as F

from keyfathom.operators import runtime, secrets, tls, verdicts
from keyfathom.plans.scans import next_findings, scan_repositories
from keyfathom.session import checkpoint_dir
from keyfathom.sinks import exports
from keyfathom.sources import tables
from keyfathom.streaming import events, runtime as stream

T0 = dt.datetime(2024, 1, 1)


def test_reading_a_tree(spark, tmp_path):
    for name, data in {"r1/src/a.py": b"MD5\r\n\xffx\r", "r1/node_modules/b.js": b"MD5", "r2/requirements.txt": b"pyjwt==1.0", "r2/x.md": b"MD5"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert rows(tables.source_files(spark, str(tmp_path))) == [("r1", "src/a.py", "MD5\nx\n")]
    assert rows(tables.manifests(spark, str(tmp_path))) == [("r2", "requirements.txt", "pyjwt==1.0")]


CBOM = "algorithm string, algo_type string, quantum_status string, nist_replacement string, priority int, total_usages long, affected_repos long"


def test_cyclonedx_is_one_document(spark, table, tmp_path):
    cbom = table(CBOM, ("MD5", "Hash", "BROKEN", 'say "no"', 1, 3, 1), ("AES-128", "Symmetric", "MONITOR", None, 4, 1, 1), ("Unused", "Hash", "SAFE", "x", 5, 0, 0))
    places = table("algorithm string, location string", ("MD5", "b#L2"), ("MD5", "a#L1"), ("MD5", "a#L1"), ("AES-128", "c"))
    lines = exports.cyclonedx_lines(cbom, places, "app", "urn:uuid:1", "2024-01-01T00:00:00+00:00")
    exports.write_cyclonedx(lines, str(tmp_path / "bom"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "bom").glob("part-*")))
    doc = json.loads(text)
    assert (doc["bomFormat"], doc["specVersion"], doc["serialNumber"], doc["metadata"]["component"]["name"]) == ("CycloneDX", "1.5", "urn:uuid:1", "app")
    md5, aes, unused = doc["components"]
    assert [o["location"] for o in md5["evidence"]["occurrences"]] == ["a#L1", "a#L1", "b#L2"]
    assert md5["x-nist-replacement"] == 'say "no"' and md5["x-total-usages"] == 3
    assert aes["cryptoProperties"]["algorithmProperties"]["nistQuantumSecurityLevel"] == 2 and aes["x-nist-replacement"] is None
    assert "evidence" not in unused


def test_replace_partitions(spark, table, tmp_path):
    path = str(tmp_path / "t")
    exports.replace_partitions(table("repo_id string, v int", ("a", 1), ("b", 2)), path)
    exports.replace_partitions(table("repo_id string, v int", ("a", 9)), path)
    assert rows(spark.read.parquet(path), "repo_id", "v") == [("a", 9), ("b", 2)]
    kept = exports.full_replace(table("repo_id string, v int", ("a", 1), ("b", 2)), table("repo_id string, v int"), table("repo_id string", ("a",)))
    assert rows(kept) == [("b", 2)]


def test_csv(spark, table, tmp_path):
    findings = table("repo_id int, algorithm string, algo_type string, quantum_status string, risk_level string, nist_replacement string, file_path string, "
                     "line_number int, migration_status string, archived boolean", (1, "MD5", "Hash", "BROKEN", "CRITICAL", None, "/a.py", 3, "open", False))
    repos = table("repo_id int, name string, url string, branch string", (1, "r", "https://x/r.git/", None))
    out = exports.inventory_rows(findings, repos, table(CBOM, ("MD5", "Hash", "BROKEN", "x", 1, 3, 1)))
    exports.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert text[0].split(",") == exports.CSV_COLUMNS
    assert "https://x/r/blob/main/a.py#L3" in text[1]


def test_secrets(table):
    files = table("repo_id string, file_path string, content string",
                  ("r", "etc/sshd_config", "Port 22\nCiphers aes256-ctr,arcfour\nMACs hmac-sha2-256\n"),
                  ("r", "id", "-----BEGIN OPENSSH PRIVATE KEY-----\n-----BEGIN CERTIFICATE-----"), ("r", "readme", "Ciphers arcfour"))
    got = secrets.find(files)
    assert rows(got, "line_number", "finding_type", "quantum_status", "risk_level") == [
        (1, "SSH_PRIVATE_KEY", "VULNERABLE", "MEDIUM"), (2, "SSH_CONFIG", "BROKEN", "CRITICAL"), (2, "TLS_CERT", "VULNERABLE", "CRITICAL"),
        (3, "SSH_CONFIG", "VULNERABLE", "HIGH")]


def test_tls_expiry_by_whole_days(table):
    rows_ = [("a", "complete", "TLSv1.3", "RSA", 2048, None, T0 + dt.timedelta(days=d, hours=1)) for d in (29, 30, -2)]
    seen = table("finding_id string, scan_status string, tls_version string, key_type string, key_size int, key_curve string, cert_not_after timestamp", *rows_)
    got = [r.issues[1:] for r in tls.grade(seen, F.lit(T0)).collect()]
    assert got == [["Certificate expires in 29 days"], [], ["Certificate is expired"]]


def test_verdicts(table):
    responses = table("response string", ('```json\n{"label": "true_positive", "confidence": -3}\n```',), ("{not json} just a comment",), ("  hm",))
    got = [(r.label, r.confidence, r.is_crypto_usage) for r in verdicts.normalise(responses).collect()]
    assert got == [("true_positive", 0.0, True), ("false_positive", 0.4, False), ("uncertain", 0.4, True)]


EVENTS = "host_id string, ts timestamp, pid long, probe_id long, comm string"


def _events(spark, path: Path, part: int, rows_):
    spark.createDataFrame(rows_, EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    data = tmp_path / "in"
    at = [T0 + dt.timedelta(seconds=s) for s in (1, 2, 31, 3600)]
    _events(spark, data, 0, [("h", t, 1, 0, "c") for t in at])
    def go():
        windows = stream.windowed_calls(spark.readStream.schema(EVENTS).parquet(str(data)), delay="1 minute")
        stream.append_windows(windows, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "occurrences", "algorithm")
    first = go()
    assert first == [(T0, 2, "MD5"), (T0 + dt.timedelta(seconds=30), 1, "MD5")]
    assert go() == first  # a restart adds nothing
    batch = stream.windowed_calls(spark.read.schema(EVENTS).parquet(str(data)))
    assert batch.count() == 3


def test_upsert_stream_survives_a_replayed_batch(spark, tmp_path):
    schema = "host_id string, algorithm string, symbol string, process_name string, pid long, library string, occurrences long, first_seen timestamp, last_seen timestamp"
    path, out = str(tmp_path / "in"), str(tmp_path / "state")
    def report(n, seconds):
        when = T0 + dt.timedelta(seconds=seconds)
        spark.createDataFrame([("h", "MD5", "MD5_Init", None, 1, "lib", n, when, when)], schema).coalesce(1).write.mode("append").parquet(path)
    def go():
        incoming = spark.readStream.schema(schema).parquet(path)
        stream.upsert_stream(incoming, out, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
        return rows(stream.current_findings(spark, out), "occurrences", "first_seen", "last_seen", "risk_level")
    report(2, 50)
    report(3, 10)
    assert go()[0][0] == 5
    report(4, 70)
    got = go()
    assert got == [(9, T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=70), "CRITICAL")]
    commit = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    commit.unlink()  # as after a crash between writing the batch and committing it
    (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    assert go() == got
    stream.compact(spark, out, str(tmp_path / "compacted"))
    assert rows(stream.current_findings(spark, str(tmp_path / "compacted")), "occurrences") == [(9,)]
    report(1, 90)
    assert go()[0][0] == 10
    assert rows(stream.current_findings(spark, out, str(tmp_path / "compacted")), "occurrences") == [(10,)]


def test_reports_with_missing_times(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"host_id": "h", "received_at": "2024-01-01T00:00:00Z", "hostname": "n", "findings": [
        {"algorithm": "MD5", "symbol": "s", "pid": 3, "occurrences": 2}]}))
    reports = tables.runtime_reports(spark, str(tmp_path))
    assert rows(tables.reported_findings(reports), "algorithm", "pid", "first_seen") == [("MD5", 3, T0)]
    assert runtime.heartbeats(reports).first().hostname == "n"


def test_reconcile_stream(spark, tmp_path):
    state = tmp_path / "findings"
    schema = ("repo_id string, scan_run_id string, file_path string, algorithm string, migration_status string, resolution_note string, "
              "source_type string, archived boolean, resolved_at timestamp, resolved_by string")
    spark.createDataFrame([("r", "0", "a", "MD5", "open", None, "source_code", False, None, None)], schema).write.parquet(str(state / "0"))
    scans, scan_schema = tmp_path / "scans", "repo_id string, scan_run_id string, file_path string, algorithm string"
    def scan(run, *found):
        spark.createDataFrame([("r", run, *f) for f in (found or [(None, None)])], scan_schema).coalesce(1).write.parquet(str(scans / run))
    def go():
        source = spark.readStream.schema(scan_schema).option("recursiveFileLookup", "true").parquet(str(scans))
        query = events.reconcile_stream(source, lambda b, runs: spark.read.parquet(str(state / str(b))),
                                        lambda df, b: df.write.mode("overwrite").parquet(str(state / str(b + 1))), F.lit(T0), str(tmp_path / "cp"))
        query.awaitTermination()
        last = max(int(p.name) for p in state.iterdir())
        return rows(spark.read.parquet(str(state / str(last))), "file_path", "migration_status", "resolution_note")
    scan("run-one", ("b", "RC4"))
    assert go() == [("a", "open", "Missed scan: run-one"), ("b", "open", None)]
    scan("run-two", ("b", "RC4"))
    assert go() == [("a", "auto_resolved", "Not detected in 2 consecutive scans"), ("b", "open", None)]
    scan("run-3", ("a", "MD5"))
    assert go() == [("a", "open", "Re-introduced in latest scan"), ("b", "open", "Missed scan: run-3")]


def test_repository_scan_end_to_end(spark, table):
    files = table("repo_id string, file_path string, content string",
                  ("r", "src/app.py", "import hashlib\n\ndef main():\n    go()\n\ndef go():\n    hashlib.md5(b'x')\n\ndef dead():\n    hashlib.sha1(b'x')\n"),
                  ("r", "tests/test_a.py", "x = 'MD5'\n"), ("r", "requirements.txt", "pyjwt==1.0\n"))
    scan = scan_repositories(files)
    got = {(r.file_path, r.algorithm): r for r in scan.code.collect()}
    assert (got["src/app.py", "MD5"].reachable, got["src/app.py", "MD5"].call_depth, got["src/app.py", "MD5"].call_chain) == (True, 1, ["main@3", "go@6"])
    assert (got["src/app.py", "SHA-1"].reachable, got["src/app.py", "SHA-1"].ai_confidence) == (False, 0.75)
    assert got["tests/test_a.py", "MD5"].ai_confidence == 0.65
    assert rows(scan.dependencies, "dependency_name") == [("pyjwt",)]
    assert rows(scan.risk) == [("r", "CRITICAL")]
    assert rows(scan.stats, "total_files", "total_findings") == [(2, 4)]
    from keyfathom.schemas import FINDINGS
    empty = spark.createDataFrame([], FINDINGS)
    table_now = next_findings(empty, scan, table("repo_id string, scan_run_id string", ("r", "1")), F.lit(T0))
    assert table_now.count() == 4 and table_now.select("finding_id").distinct().count() == 4
    again = next_findings(spark.createDataFrame(table_now.collect(), table_now.schema), scan, table("repo_id string, scan_run_id string", ("r", "2")), F.lit(T0))
    assert again.count() == 4 and {r.scan_run_id for r in again.collect()} == {"2"}


def test_raw_events_and_observations(spark, tmp_path):
    stamp = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000_000 + 1_500
    spark.createDataFrame([("h", stamp, 1, 1, 0, "c")], "host_id string, timestamp_ns long, pid long, tid long, probe_id long, comm string").write.parquet(str(tmp_path / "e"))
    assert rows(tables.raw_events(spark, str(tmp_path / "e")), "ts", "pid", "probe_id") == [(T0 + dt.timedelta(microseconds=1), 1, 0)]
    spark.createDataFrame([("f", " http://h:8443/x/y ", "complete")], "finding_id string, endpoint_raw string, scan_status string").write.parquet(str(tmp_path / "t"))
    seen = tls.with_endpoint(tables.tls_observations(spark, str(tmp_path / "t")))
    assert rows(seen, "endpoint", "host", "port", "tls_version") == [("h:8443", "h", 8443, None)]
    (tmp_path / "adv.json").write_text(json.dumps({"id": "A", "ecosystem": "PyPI", "package": "x", "summary": "weak cipher", "aliases": ["CVE-1"], "severity": ["9.1"]}))
    from keyfathom.operators.dependencies import grade_advisories
    assert rows(grade_advisories(tables.advisories(spark, str(tmp_path / "adv.json"))), "id", "ecosystem", "algorithm", "risk_level") == [("A", "pypi", "RSA-2048", "CRITICAL")]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_damaged_and_deep_archives_do_not_end_the_scan(table):
    import io
    import zipfile

    from keyfathom.operators.native import binary_findings, bytecode_findings
    from keyfathom.sources.archives import unpack

    def jar(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, body in members.items():
                archive.writestr(name, body)
        return out.getvalue()

    kinds = b"\xca\xfe\xba\xbe\x00\x00\x00\x34" + b"\x00RSA_generate_key_ex\x00"
    deep = jar({"A.class": kinds, "B.class": kinds})
    for k in range(10):
        deep = jar({f"level{k}.jar": deep})
    damaged = bytearray(jar({"good.txt": b"fine", "bad.txt": b"x" * 100}))
    at = bytes(damaged).index(b"bad.txt") + len("bad.txt")
    damaged[at:at + 20] = b"y" * 20
    members = unpack(table("artifact_id string, artifact_name string, content binary", ("1", "deep.jar", deep),
                           ("2", "damaged.zip", bytes(damaged)), ("3", "junk.zip", b"PKjunk")))
    found = {(r.artifact_id, r.file_path.rsplit("/", 1)[-1]): r.content and bytes(r.content) for r in members.collect()}
    assert found["1", "A.class"] == kinds and found["2", "good.txt"] == b"fine" and found["2", "bad.txt"] is None
    assert found["3", ""] == b"PKjunk"
    assert binary_findings(members).count() == 0
    assert bytecode_findings(members).where("artifact_id = '1'").groupBy("algorithm").count().where("count > 1").isEmpty()
