"""Artifacts of every type, whole and damaged: findings and ledger."""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.operators import native
from keyfathom.plans.scans import scan_artifact_files
from keyfathom.sources import archives

ELF, PE, MACHO = b"\x7fELF\x02\x00\x00", b"MZ\x90\x00\x03\x00\x00", b"\xcf\xfa\xed\xfe\x00"
CLASS = b"\xca\xfe\xba\xbe\x00\x00\x00\x34\x00"
SYMBOL = b"\x00RSA_generate_key\x00"


def packed(members: dict[str, bytes], mode: str | None = None) -> bytes:
    out = io.BytesIO()
    if mode is None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, data in members.items():
                archive.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode=mode) as archive:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def unix(members: dict[str, bytes]) -> bytes:
    """With a long name, a symbol table and bodies of odd length."""
    long_names = b"".join(f"{n}/\n".encode() for n in members if len(n) > 15)
    out = b"!<arch>\n"
    def entry(name: bytes, body: bytes) -> bytes:
        return name.ljust(16) + b"0".ljust(32) + str(len(body)).encode().ljust(10) + b"`\n" + body + b"\n" * (len(body) % 2)
    out += entry(b"/", b"\0\0\0\0") + (entry(b"//", long_names) if long_names else b"")
    for name, body in members.items():
        at = long_names.find(f"{name}/".encode())
        out += entry(f"/{at}".encode() if len(name) > 15 else f"{name}/".encode(), body)
    return out


def encrypted(data: bytes, name: str) -> bytes:
    """The same zip, one member marked as encrypted in both of its headers."""
    out = bytearray(data)
    for mark, flag in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = out.find(mark)
        while at >= 0:
            length = 30 if flag == 6 else 46
            if out[at + length:at + length + len(name)] == name.encode():
                out[at + flag] |= 1
            at = out.find(mark, at + 4)
    return bytes(out)


JAR = packed({"a/A.class": CLASS + b"\x00java/security/Signature\x00", "b/B.class": CLASS + b"\x00javax/crypto/Cipher\x00"})
TREE = {"usr/bin/tool": ELF + b"\x00MD5_Init\x00", "app/requirements.txt": b"pyjwt==1.0\n", "readme": SYMBOL}
CUT = packed({"usr/lib/a.so": ELF + SYMBOL, "usr/lib/b.so": ELF + bytes(range(256)) * 4000 + SYMBOL}, "w:gz")
BAD = b"pyjwt==1.0\n"
CASES = {
    "lib.so.1": (ELF + b"\x00" * 5000 + SYMBOL, [("lib.so.1", "RSA-2048")], "native_elf", "complete"),
    "setup.exe": (PE + b"\x00RC4_set_key\x00SHA1_Init\x00", [("setup.exe", "RC4"), ("setup.exe", "SHA-1")], "native_pe", "complete"),
    "x.dylib": (MACHO + SYMBOL, [("x.dylib", "RSA-2048")], "native_macho", "complete"),
    "notes": (b"plain text, DES and\nMD5_Transform", [("notes", "DES"), ("notes", "MD5")], "unknown", "complete"),
    "short": (b"\x00MD5\x00\x01DES\x02", [], "unknown", "complete"),
    "p.rpm": (b"\xed\xab\xee\xdb" + b"\x03\x00" * 50 + SYMBOL, [("p.rpm", "RSA-2048")], "rpm", "complete"),
    "lib.a": (unix({"one.o": ELF + b"\x00MD5_Init\x00", "a_rather_long_name.o": ELF + SYMBOL + b"\x00MD5_Final\x00", "t": SYMBOL}),
              [("lib.a/a_rather_long_name.o", "RSA-2048"), ("lib.a/a_rather_long_name.o", "MD5")], "static_archive", "complete"),
    "p.deb": (unix({"debian-binary": b"2.0\n", "control.tar.gz": packed({"./control": b"Depends: libssl3\n"}, "w:gz"),
                    "data.tar.xz": packed({"./" + n: d for n, d in TREE.items()}, "w:xz")}),
              [("p.deb/usr/bin/tool", "MD5"), ("p.deb/app/requirements.txt", "JWT-RS256")],
              "deb", "complete"),
    "app.apk": (packed({"lib/x86/n.so": ELF + SYMBOL + b"DES_ecb_encrypt\x00", "classes.dex": b"dex\n035\x00" + b"javax/crypto/Cipher;\x00",
                        "inner/other.dex": b"dex\n035\x00" + b"\x00MD5_Init\x00"}),
                [("app.apk/classes.dex", "RSA-2048"), ("app.apk/lib/x86/n.so", "DES")], "android_apk", "complete"),
    "lib.aar": (packed({"classes.jar": JAR, "jni/x86/n.so": ELF + SYMBOL}),
                [("lib.aar/classes.jar/a/A.class", "RSA-2048"), ("lib.aar/jni/x86/n.so", "RSA-2048")], "android_aar", "complete"),
    "image.tar": (packed({"l1/layer.tar": packed(TREE, "w"), "l2/layer.tar": packed({"x/requirements.txt": b"pyjwt==9.0\n"}, "w"),
                          "manifest.json": json.dumps([{"Layers": ["l1/layer.tar", "l2/layer.tar"]}]).encode()}, "w"),
                  [("image.tar/usr/bin/tool", "MD5"), ("image.tar/app/requirements.txt", "JWT-RS256")], "container_image", "complete"),
    "x.gem": (packed({"metadata.gz": gzip.compress(b"name: x\ndependencies:\n  name: jwt\n"), "data.tar.gz": packed(TREE, "w:gz")}, "w"),
              [("x.gem/usr/bin/tool", "MD5"), ("x.gem/app/requirements.txt", "JWT-RS256")],
              "ruby_gem", "complete"),
    "some.zip": (packed({"bin/t": ELF + SYMBOL, "t.txt": SYMBOL}), [("some.zip/bin/t", "RSA-2048")], "zip_generic", "complete"),
    "none.whl": (None, [], "python_wheel", "failed"),
    "junk.whl": (b"PK junk", [], "python_wheel", "failed"),
    "junk.bin": (b"PK junk DES_ecb_encrypt", [("junk.bin", "DES")], "unknown", "complete"),
    "locked.zip": (encrypted(packed({"bin/t": ELF + SYMBOL, "bin/u": ELF + b"\x00MD5_Init\x00"}), "bin/t"),
                   [("locked.zip/bin/u", "MD5")], "zip_generic", "partial"),
    "shut.whl": (encrypted(packed({"a.dist-info/METADATA": b"Requires-Dist: pyjwt (1.0)\n"}), "a.dist-info/METADATA"), [],
                 "python_wheel", "failed"),
    "cut.tar.gz": (CUT[:len(CUT) // 2], [("cut.tar.gz/usr/lib/a.so", "RSA-2048")], "python_sdist", "partial"),
    "bad-inner.jar": (packed({"lib/in.jar": JAR[:80], "A.class": CLASS + b"\x00javax/crypto/Cipher\x00"}),
                      [("bad-inner.jar/A.class", "RSA-2048")], "java_jar", "partial"),
    "empty.jar": (packed({}), [], "java_jar", "complete"),
    "empty": (b"", [], "unknown", "complete"),
}


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(f"id-{n}", n, None if c[0] is None else bytearray(c[0]), 1) for n, c in CASES.items()]
    artifacts = spark.createDataFrame(rows, "artifact_id string, artifact_name string, content binary, kind int")
    return scan_artifact_files(artifacts, piece_bytes=1000)


def test_findings(scan):
    found: dict[str, set] = {}
    for r in scan.findings.collect():
        found.setdefault(r.artifact_id, set()).add((r.file_path, r.algorithm))
        assert r.source_type == "artifact" and r.quantum_safe is False
    for name, (_, expected, *_) in CASES.items():
        assert found.get(f"id-{name}", set()) == set(expected), name


def test_ledger(scan):
    rows = {r.artifact_name: r for r in scan.ledger.collect()}
    assert set(rows) == set(CASES)
    for name, (_, expected, kind, status) in CASES.items():
        r = rows[name]
        assert (r.artifact_type, r.status, r.n_findings) == (kind, status, len(expected)), (name, r)
        assert bool(r.reason) == (status != "complete") and (r.n_unread > 0 or name == "none.whl") == (status != "complete"), r
    assert rows["locked.zip"].n_members == 2 and "encrypted" in rows["locked.zip"].reason
    assert rows["none.whl"].reason == "no content" and "BadZipFile" in rows["bad-inner.jar"].reason


def test_context(scan):
    shown = {(r.file_path, r.algorithm): r.context for r in scan.findings.collect()}
    assert shown["lib.so.1", "RSA-2048"] == "Crypto symbol/string found in binary: 'RSA_generate_key'"
    assert shown["x.dylib", "RSA-2048"] == "Crypto symbol found in Mach-O binary: 'RSA_generate_key'"
    assert shown["lib.aar/classes.jar/a/A.class", "RSA-2048"] == "Crypto API reference found in bytecode: classes.jar/a/A.class"


@pytest.mark.parametrize("size", [300, 1000, 1 << 20])
def test_pieces_give_what_whole_files_give(spark, size):
    words = [b"MD5", b"MD5_Init", b"XMD5", b"MD5x", b"DES", b"RC4_set_keys", b"RC4_set_key", b"javax/crypto/KeyPairGenerator", b"abc"]
    rows = []
    for shift in range(0, 400):
        fill = [b"\x00", b"\x01\x02", b"  ", b"a ", b"_", b".", b"\t"][shift % 7]
        body = (fill * 2000)[:560 + shift] + words[shift % len(words)] + (fill * 2000)[:700] + words[(shift * 5) % len(words)]
        rows.append((str(shift), f"f{shift}", bytearray(body)))
    artifacts = spark.createDataFrame(rows, "artifact_id string, artifact_name string, content binary")
    expected = set()
    for name, _, body in rows:
        text = "\n".join(re.findall(r"[\t\x20-\x7e]{4,}", body.decode("latin-1")))
        firsts: dict[str, str] = {}
        for pattern, algorithm, *_ in grades.NATIVE_SYMBOLS:
            if match := re.search(pattern, text, re.ASCII):
                firsts.setdefault(algorithm, match.group(0))
        expected |= {(name, a, f"Crypto symbol/string found in binary: '{s}'") for a, s in firsts.items()}
    found = scan_artifact_files(artifacts, piece_bytes=size).findings
    assert {(r.artifact_id, r.algorithm, r.context) for r in found.collect()} == expected


def test_no_symbol_is_longer_than_the_overlap():
    assert all(re._parser.parse(p).getwidth()[1] + 2 * 6 + 2 < archives.OVERLAP for p, *_ in grades.NATIVE_SYMBOLS)


def test_no_artifacts(spark):
    scan = scan_artifact_files(spark.createDataFrame([], "artifact_id string, artifact_name string, content binary"))
    assert scan.findings.count() == 0 and scan.ledger.count() == 0


def test_unreadable_members_have_no_content(spark):
    data = {n: CASES[n][0] for n in ("locked.zip", "cut.tar.gz", "none.whl")}
    rows = [(n, n, d and bytearray(d)) for n, d in data.items()]
    found = archives.unpack(spark.createDataFrame(rows, "artifact_id string, artifact_name string, content binary"))
    got = {(r.artifact_id, r.file_path): r.content is not None for r in found.collect()}
    assert got == {("locked.zip", "bin/t"): False, ("locked.zip", "bin/u"): True, ("cut.tar.gz", "usr/lib/a.so"): True,
                   ("cut.tar.gz", "usr/lib/b.so"): False, ("cut.tar.gz", ""): False, ("none.whl", ""): False}
    assert native.binary_findings(found).where(F.col("artifact_id") == "locked.zip").count() == 1


def test_small_archives_share_a_batch(spark):
    class Rows:
        """Gives out the function that unpack would run in tasks."""

        def select(self, *columns):
            return self

        def mapInPandas(self, read, schema):
            return read

    contents = [packed({"a": b"1", "b": b"2"}), b"\x7fELF\x02", None, packed({"c": b"3"}, "w:gz"), b""] * 1000
    frame = pd.DataFrame({"artifact_id": [str(n) for n in range(5000)], "artifact_name": "x", "content": pd.Series(contents, dtype=object)})
    frames = list(archives.unpack(Rows())(iter([frame])))
    assert len(frames) <= 5 and sum(map(len, frames)) == 6000
    all_rows = pd.concat(frames)
    assert all_rows["artifact_id"].tolist()[:8] == ["0", "0", "1", "2", "3", "4", "5", "5"]
    assert all_rows["file_path"].tolist()[:6] == ["a", "b", "", "", "c", ""]


def test_types_are_joined_without_a_broadcast_of_all_archives(spark, table):
    rows = table("artifact_id string, artifact_name string, content binary", ("1", "a.bin", bytearray(packed({"x.nuspec": b""}))), (None, "b", None))
    found = archives.artifact_types(rows, archives.unpack(rows))
    assert sorted(r.artifact_type for r in found.collect()) == ["nuget", "unknown"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_table_in_few_splits_is_dealt_to_all_cores(spark, tmp_path):
    from keyfathom.checks.views import Inputs
    spark.range(100).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = Inputs(spark, str(tmp_path)).sql("SELECT p_partkey FROM part", deal=True)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and got.count() == 100


def test_workers_get_small_batches_of_artifacts(spark, table):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = table("artifact_id string, artifact_name string, content binary", ("1", "a.so", bytearray(ELF + SYMBOL)))
    try:
        spark.conf.unset(name)
        scan_artifact_files(rows)
        assert int(spark.conf.get(name)) == 4 << 20
        spark.conf.set(name, "1048576")
        scan_artifact_files(rows)
        assert spark.conf.get(name) == "1048576"
    finally:
        spark.conf.set(name, before)
