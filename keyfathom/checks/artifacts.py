"""Checks of artifact scans: one artifact of some type, whole or damaged, packed around every source file."""

from __future__ import annotations

import io
import json
import random
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from keyfathom.checks.base import check
from keyfathom.checks.supply import zipped
from keyfathom.checks.views import Inputs
from keyfathom.plans.scans import scan_artifact_files

ELF, PE = b"\x7fELF\x02\x00\x00", b"MZ\x90\x00\x03\x00\x00"
CLASS = b"\xca\xfe\xba\xbe\x00\x00\x00\x34\x00"
#: Small pieces, so that symbols of common files stand across their borders.
PIECE_BYTES = 512


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def _tar(members: dict[str, bytes], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _ar(members: dict[str, bytes]) -> bytes:
    return b"!<arch>\n" + b"".join(
        f"{name}/".encode().ljust(16) + b"0".ljust(32) + str(len(data)).encode().ljust(10) + b"`\n" + data + b"\n" * (len(data) % 2)
        for name, data in members.items())


def _locked(text: bytes) -> bytes:
    """A zip whose first member, bin/a, is marked as encrypted in both of its headers."""
    data = bytearray(_zip({"bin/a": ELF + b"\0RSA_sign\0", "bin/b": ELF + b"\0MD5_Init\0", "t.txt": text}))
    data[data.find(b"PK\x03\x04") + 6] |= 1
    data[data.find(b"PK\x01\x02") + 8] |= 1
    return bytes(data)


def _cut(text: bytes) -> bytes:
    noise = random.Random(len(text)).randbytes(20_000).translate(bytes(range(128)) * 2)
    whole = _tar({"lib/a.so": ELF + b"\0RSA_sign\0", "t.txt": text[:100], "lib/b.bin": noise}, "w:gz")
    return whole[:len(whole) // 2]


def _image(text: bytes) -> bytes:
    return _tar({"l1/layer.tar": _tar({"app/requirements.txt": b"pyjwt==1.0\n", "t.txt": text}, "w"),
                 "l2/layer.tar": _tar({"app/requirements.txt": b"pyjwt==9.0\n"}, "w"),
                 "manifest.json": json.dumps([{"Layers": ["l1/layer.tar", "l2/layer.tar"]}]).encode()}, "w")


# (ending of the name, content made of the file's bytes, type, status, members, members not read,
#  (path, algorithm) of its findings)
Case = tuple[str, Callable[[bytes], bytes | None], str, str, int, int, list[tuple[str, str]]]
CASES: list[Case] = [
    (".so.2", lambda t: ELF + b"\0" * len(t) + b"\0RSA_generate_key\0", "native_elf", "complete", 1, 0, [("", "RSA-2048")]),
    (".exe", lambda t: PE + b"\1" * len(t) + b"\0MD5_Init\0" + b" " * len(t) + b"RC4_set_key\0", "native_pe", "complete", 1, 0,
     [("", "MD5"), ("", "RC4")]),
    (".dat", lambda t: b" " * len(t) + b"DES_ecb_encrypt" + b"\n" * len(t) + b"XMD5_Init", "unknown", "complete", 1, 0, [("", "DES")]),
    (".a", lambda t: _ar({"a.o": ELF + b"\0MD5_Init\0", "b.o": ELF + b"\0" * len(t) + b"\0MD5_Final\0SHA1_Init\0", "t": t}),
     "static_archive", "complete", 3, 0, [("a.o", "MD5"), ("b.o", "SHA-1")]),
    (".apk", lambda t: _zip({"lib/x/n.so": ELF + b"\0RSA_sign\0SHA1_Init\0", "classes.dex": b"dex\n035\0" + b"\0javax/crypto/Cipher;\0",
                             "t.txt": t}),
     "android_apk", "complete", 3, 0, [("classes.dex", "RSA-2048"), ("lib/x/n.so", "SHA-1")]),
    (".rpm", lambda t: b"\xed\xab\xee\xdb" + b"\3\0" * len(t) + b"\0ECDSA_sign\0", "rpm", "complete", 1, 0, [("", "ECDSA-P256")]),
    (".deb", lambda t: _ar({"debian-binary": b"2.0\n", "control.tar.gz": _tar({"./control": b"Depends: libssl3\n"}, "w:gz"),
                            "data.tar.xz": _tar({"./usr/bin/t": ELF + b"\0MD5_Init\0", "./t.txt": t}, "w:xz")}),
     "deb", "complete", 4, 0, [("usr/bin/t", "MD5")]),
    (".image", _image, "container_image", "complete", 4, 0, [("app/requirements.txt", "JWT-RS256")]),
    (".egg", lambda t: None, "python_wheel", "failed", 0, 0, []),
    (".locked", _locked, "zip_generic", "partial", 3, 1, [("bin/b", "MD5")]),
    (".tgz", _cut, "python_sdist", "partial", 4, 1, [("lib/a.so", "RSA-2048")]),
    (".nupkg", lambda t: b"PK" + t, "nuget", "failed", 1, 1, []),
    (".gem", lambda t: _tar({"data.tar.gz": _tar({"ext/n.so": ELF + b"\0RSA_sign\0", "t.txt": t}, "w:gz")}, "w"), "ruby_gem", "complete",
     2, 0, [("ext/n.so", "RSA-2048")]),
    (".war", lambda t: _zip({"WEB-INF/lib/in.jar": _zip({"b/B.class": CLASS + b"\0javax/crypto/Cipher\0",
                                                        "a/A.class": CLASS + b"\0java/security/Signature\0"}), "t.txt": t}),
     "java_war", "complete", 3, 0, [("WEB-INF/lib/in.jar/a/A.class", "RSA-2048")]),
]


def typed(files: DataFrame) -> DataFrame:
    """One artifact per file, of the type that its number gives."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ending, make, *_ = CASES[r.doc_id % len(CASES)]
                yield pd.DataFrame({"artifact_id": [f"t{r.doc_id}"], "artifact_name": [f"t{r.doc_id}{ending}"],
                                    "content": pd.Series([make(r.content.encode())], dtype=object)})

    return files.select("doc_id", "content").mapInPandas(pack, "artifact_id string, artifact_name string, content binary")


_STATES = ", ".join(f"({k}, '{ending}', '{kind}', '{status}', {n}, {unread}, {len(found)})"
                    for k, (ending, _, kind, status, n, unread, found) in enumerate(CASES))
_FOUND = ", ".join(f"({k}, '{ending}', '{path}', '{algorithm}')" for k, (ending, *_, found) in enumerate(CASES)
                   for path, algorithm in found)


@check("artifact_scan", f"""
SELECT CAST(doc_id AS VARCHAR) AS artifact_id, 'd' || doc_id || '.whl/a-1.dist-info/METADATA' AS file_path, 'JWT-RS256' AS algorithm FROM files_v
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'd' || doc_id || '.whl/lib/in.jar/A.class', 'RSA-2048' FROM files_v
UNION ALL SELECT 't' || doc_id, 't' || doc_id || ending || CASE WHEN path = '' THEN '' ELSE '/' || path END, algorithm
FROM files_v JOIN (VALUES {_FOUND}) AS f(k, ending, path, algorithm) ON doc_id % {len(CASES)} = k""")
def artifact_scan(i: Inputs) -> DataFrame:
    both = zipped(i.files()).unionByName(typed(i.files()))
    return scan_artifact_files(both, PIECE_BYTES).findings.select("artifact_id", "file_path", "algorithm")


@check("artifact_status", f"""
SELECT 't' || doc_id AS artifact_id, 't' || doc_id || ending AS artifact_name, artifact_type, status, n_members, n_unread, n_findings,
       status <> 'complete' AS has_reason
FROM files_v JOIN (VALUES {_STATES}) AS s(k, ending, artifact_type, status, n_members, n_unread, n_findings) ON doc_id % {len(CASES)} = k""")
def artifact_status(i: Inputs) -> DataFrame:
    ledger = scan_artifact_files(typed(i.files()), PIECE_BYTES).ledger
    return ledger.selectExpr("artifact_id", "artifact_name", "artifact_type", "status", "CAST(n_members AS INT) AS n_members",
                             "CAST(n_unread AS INT) AS n_unread", "CAST(n_findings AS INT) AS n_findings", "reason <> '' AS has_reason")
