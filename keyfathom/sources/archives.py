"""Opening package archives inside the tasks.

Archive formats have no Spark reader, so members are listed with the standard
library: one archive at a time per task, its members read as streams.  A member
that is searched leaves the task in overlapping pieces of bounded size, one that
only concerns the ledger not at all.  Everything after that is ordinary DataFrame
work.
"""

from __future__ import annotations

import gzip
import io
import json
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfathom.dims import grades
from keyfathom.functions.text import decode_text
from keyfathom.schemas import MEMBERS
from keyfathom.session import small_batches

BATCH_BYTES = 32 << 20
#: Rows that leave a task at once, at most: small archives share a batch.
BATCH_ROWS = 2_000
#: Bytes of a piece of a searched member, and how far a piece reaches back into the one before.
PIECE_BYTES, OVERLAP = 1 << 20, 256
#: What the standard library raises for damaged, encrypted and unknown contents.
BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, ValueError, RuntimeError,
          NotImplementedError)
_COLUMNS = [part.split()[0] for part in MEMBERS.split(", ")]

# ---- FIXED VALUES: types told by member names, in this order; manifests ---------

ZIP_TYPES = [("python_wheel", r"(^|/)METADATA$"), ("android_aar", r"(^|/)classes\.jar$"),
             ("android_apk", r"(^|/)classes\.dex$"), ("nuget", r"\.nuspec$"), ("java_jar", r"pom\.xml$")]
TAR_TYPES = [("container_image", r"^manifest\.json$"), ("python_sdist", r"(PKG-INFO|setup\.py)$")]
AR_MAGIC = b"!<arch>\n"
INNER_TAR = r"^(data|control)\.tar(\.\w+)?$"
PACKED_MANIFEST = (r"(?i)(^|/)(requirements([._-].+)?\.txt|pyproject\.toml|pom\.xml|package\.json|metadata|pkg-info"
                   r"|control|[^/]*\.nuspec|metadata\.gz|metadata\.yaml)$|(^|/)var/lib/dpkg/status$")

# ---- END OF FIXED VALUES ---------------------------------------------------------

#: Types whose file is searched as it is.
WHOLE_TYPES = ("native_elf", "native_pe", "native_macho", "rpm", "unknown")


class Member(NamedTuple):
    """A file in an archive; one that cannot be opened has no body, but a reason."""

    jar: str
    layer: int | None
    path: str
    body: BinaryIO | None
    reason: str


def _said(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def _zip_members(stream: BinaryIO) -> Iterator[tuple[str, BinaryIO | None, str]]:
    with zipfile.ZipFile(stream) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            try:
                body, reason = archive.open(info), ""
            except BROKEN as error:
                body, reason = None, _said(error)
            yield info.filename, body, reason


def _tar_members(stream: BinaryIO) -> Iterator[tuple[str, BinaryIO | None, str]]:
    with tarfile.open(fileobj=stream) as archive:
        for info in archive:
            if info.isfile():
                yield info.name.removeprefix("./"), archive.extractfile(info), ""


def _ar_members(stream: BinaryIO) -> Iterator[tuple[str, BinaryIO | None, str]]:
    """Members of a Unix archive: headers of 60 bytes, bodies padded to even length."""
    if stream.read(8) != AR_MAGIC:
        raise ValueError("not a Unix archive")
    long_names = b""
    while header := stream.read(60):
        if len(header) < 60 or header[58:] != b"`\n":
            raise EOFError("broken header of a Unix archive")
        name, size = header[:16].rstrip(), int(header[48:58])
        body = stream.read(size)
        if len(body) < size:
            raise EOFError(f"{name!r} is cut")
        stream.read(size % 2)
        if name == b"//":
            long_names = body
        elif name not in (b"/", b"/SYM64/") and not name.startswith(b"__.SYMDEF"):
            if name.startswith(b"#1/"):
                name, body = body[:int(name[3:])].rstrip(b"\0"), body[int(name[3:]):]
            elif name[:1] == b"/":
                name = long_names[int(name[1:]):].split(b"\n")[0]
            yield name.rstrip(b"/").decode("utf-8", "replace"), io.BytesIO(body), ""


def _layers(stream: BinaryIO) -> dict[str, int]:
    """Layer path -> position, from an image's manifest; a pass of its own over the tar.

    None in an archive that breaks before its manifest: what comes before the break is then read as it is.
    Raises what opening raises where there is no tar at all.
    """
    with tarfile.open(fileobj=stream) as archive:
        manifests = (archive.extractfile(m) for m in archive if m.isfile() and m.name.removeprefix("./") == "manifest.json")
        try:
            images = next((json.loads(body.read()) for body in manifests), [])
        except BROKEN:
            return {}
    order = [layer for image in images for layer in image.get("Layers", [])]
    return {layer: i for i, layer in reversed(list(enumerate(order)))}


def members(stream: BinaryIO, prefix: str = "", jar: str = "", layer: int | None = None) -> Iterator[Member]:
    """All files of a zip, tar or Unix archive; jars, layers and packed trees in it are opened in place.

    Raises one of BROKEN where the archive cannot be read (on).  What is inside it and
    cannot be read is a member without a body.  A body is to be read before the next member is asked for.
    """
    head = stream.read(8)
    stream.seek(0)
    layers: dict[str, int] = {}
    if head[:2] == b"PK":
        listed = _zip_members(stream)
    elif head == AR_MAGIC:
        listed = _ar_members(stream)
    else:
        layers = _layers(stream)
        stream.seek(0)
        listed = _tar_members(stream)
    for name, body, reason in listed:
        path = prefix + name
        inner_jar = name.lower().endswith(".jar")
        if body is not None and (inner_jar or name in layers or re.search(INNER_TAR, name)):
            seen = 0
            try:
                body = io.BytesIO(body.read())
                for inner in members(body, path + "/" if inner_jar else prefix, path if inner_jar else jar,
                                     layers.get(name, layer)):
                    yield inner
                    seen += 1
                continue
            except BROKEN as error:
                reason = _said(error)
                if seen or not isinstance(body, io.BytesIO):
                    body = None
                else:
                    body.seek(0)
        elif body is not None and name.endswith("metadata.gz"):
            body = gzip.GzipFile(fileobj=body)
        yield Member(jar, layer, path, body, reason)


def unpack(artifacts: DataFrame) -> DataFrame:
    """Members of archives, nested jars and image layers included, with their whole contents.

    ``artifacts(artifact_id, artifact_name, content)``.  An archive of which nothing can be read
    yields one row with an empty path and the bytes as they are; a member that cannot be read has a
    null content; a null artifact yields one row with an empty path and no content.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                seen = 0
                key = (row.artifact_id, row.artifact_name)
                data = None if row.content is None else bytes(row.content)
                try:
                    for m in members(io.BytesIO(data)) if data is not None else ():
                        try:
                            content = None if m.body is None else m.body.read()
                        except BROKEN:
                            content = None
                        rows.append((*key, m.jar, m.layer, m.path, len(content or b""), content))
                        seen += 1
                        held += len(content or b"")
                        if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield _frame(rows)
                            rows, held = [], 0
                    if data is None:
                        rows.append((*key, "", None, "", 0, None))
                except BROKEN:
                    rows.append((*key, "", None, "", len(data), None if seen else data))
                    held += 0 if seen else len(data)
                if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    return artifacts.select("artifact_id", "artifact_name", "content").mapInPandas(read, MEMBERS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    frame["layer"] = frame["layer"].astype("Int32")
    return frame


_PIECE_COLUMNS = {"artifact_id": "string", "artifact_name": "string", "artifact_type": "string", "kind": "string",
                  "jar": "string", "layer": "int", "file_path": "string", "offset": "long", "content": "binary",
                  "status": "string", "reason": "string", "n_members": "long", "n_unread": "long"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _is_text(byte: int) -> bool:
    return byte == 9 or 0x20 <= byte < 0x7f


def pieces(body: BinaryIO, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a stream, each piece reaching back OVERLAP bytes.

    What stands at an inner edge may be cut there, but whole in the other piece: a printable byte
    at an inner edge reads "x", so that no word can seem to begin or to end at it.
    """
    begin, piece = 0, body.read(size)
    while True:
        try:
            more, broken = body.read(size), None
        except BROKEN as error:
            more, broken = b"", error
        shown = bytearray(piece)
        if begin and shown and _is_text(shown[0]):
            shown[0] = ord("x")
        if more and _is_text(shown[-1]):
            shown[-1] = ord("x")
        yield begin, bytes(shown)
        if broken:
            raise broken
        if not more:
            return
        begin += max(0, len(piece) - OVERLAP)
        piece = piece[-OVERLAP:] + more


def _sniffed(data: bytes, name: str) -> str:
    """Type of a zip or tar told by its members."""
    try:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                inside, types, rest = archive.namelist(), ZIP_TYPES, "zip_generic"
        else:
            rest = "python_sdist" if name.lower().endswith((".tar.gz", ".tgz")) else "unknown"
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                inside, types = [n.removeprefix("./") for n in archive.getnames()], TAR_TYPES
    except BROKEN:
        return "unknown" if data[:2] == b"PK" else rest
    return next((kind for kind, pattern in types if any(re.search(pattern, n) for n in inside)), rest)


def _kind(artifact_type: str, path: str, head: bytes) -> str | None:
    """What is looked for in a member: packages or symbols, or nothing."""
    if re.search(PACKED_MANIFEST, path):
        return "manifest"
    if path.endswith(".class"):
        return "class"
    magic = head[:4].hex().upper()
    if magic == grades.ELF_MAGIC or (artifact_type == "android_apk" and "/" not in path and path.endswith(".dex")):
        return "native"
    return "macho" if magic in grades.MACHO_MAGICS else None


def _searched(artifact_type: str, data: bytes, size: int) -> Iterator[dict]:
    """Pieces of what is searched in one artifact, and last its row of the ledger."""
    status, reason, read, unread = "complete", "", 0, 0
    try:
        if artifact_type in WHOLE_TYPES:
            kind = "macho" if artifact_type == "native_macho" else "native"
            listed = iter([Member("", None, "", io.BytesIO(data), "")])
        else:
            kind, listed = None, members(io.BytesIO(data))
        for m in listed:
            problem = m.reason
            try:
                if m.body is not None:
                    whole = re.search(PACKED_MANIFEST, m.path) and not kind
                    parts = iter([(0, m.body.read())]) if whole else pieces(m.body, size)
                    offset, piece = next(parts)
                    found = kind or _kind(artifact_type, m.path, piece)
                    while found and piece is not None:
                        yield {"kind": found, "jar": m.jar, "layer": m.layer, "file_path": m.path, "offset": offset,
                               "content": piece}
                        offset, piece = next(parts, (0, None))
            except BROKEN as error:
                problem = problem or _said(error)
            read += not problem
            unread += bool(problem)
            reason = reason or (f"{m.path}: {problem}" if problem else "")
    except BROKEN as error:
        reason, unread = _said(error), unread + 1
    if unread:
        status = "partial" if read else "failed"
    yield {"kind": "status", "status": status, "reason": reason, "n_members": read + unread, "n_unread": unread}


def artifact_pieces(artifacts: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """What artifacts hold that is worth a search, in pieces, and one row of kind "status" for each artifact.

    ``artifacts(artifact_id, artifact_name, content)``.  Kinds are manifest (one piece), class, native and
    macho.  The type of an artifact decides: libraries, programs, RPM packages and files of unknown
    type are searched as they are, all others are opened; a top-level dex file counts as native in an
    Android package only.  A worker holds a small batch of artifacts (`small_batches`) and one artifact's contents.  A status is complete, partial (something could not be read; `reason` is the
    first such thing) or failed (nothing could, or the content is null).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):  # one at a time: contents are large
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                data, kind = row["content"], row["known"]
                if data is None:
                    found = iter([{"kind": "status", "status": "failed", "reason": "no content", "n_members": 0, "n_unread": 0}])
                else:
                    if kind is None:
                        packed = data[:2] in (b"PK", b"\x1f\x8b") or data[257:262] == b"ustar"
                        kind = _sniffed(data, row["artifact_name"] or "") if packed else "unknown"
                    found = _searched(kind, data, piece_bytes)
                key = {"artifact_id": row["artifact_id"], "artifact_name": row["artifact_name"], "artifact_type": kind}
                rows, held = [], 0
                for part in found:
                    rows.append(key | part)
                    held += len(part.get("content", b""))
                    if held > BATCH_BYTES // 4:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    small_batches(artifacts.sparkSession)
    known = artifacts.select("artifact_id", "artifact_name", "content", F.coalesce(
        type_by_name(F.col("artifact_name")), type_by_magic(F.col("content"))).alias("known"))
    return known.mapInArrow(read, ", ".join(f"{c} {t}" for c, t in _PIECE_COLUMNS.items()))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in _PIECE_COLUMNS.items()],
                                      names=list(_PIECE_COLUMNS))


def text_members(members: DataFrame) -> DataFrame:
    """Members as text, for the manifest readers."""
    return members.withColumn("content", decode_text(F.col("content")))


def type_by_name(name: Column) -> Column:
    """Artifact type told by the file name alone, else null."""
    low = F.lower(name)
    return (F.when(low.rlike(r"\.(whl|egg)$"), "python_wheel")
            .when(low.rlike(r"\.jar$"), "java_jar").when(low.rlike(r"\.(war|ear)$"), "java_war")
            .when(low.rlike(r"\.aar$"), "android_aar").when(low.rlike(r"\.apk$"), "android_apk")
            .when(low.rlike(r"\.nupkg$"), "nuget").when(low.rlike(r"\.gem$"), "ruby_gem")
            .when(low.rlike(r"\.s?rpm$"), "rpm").when(low.rlike(r"\.u?deb$"), "deb")
            .when(low.rlike(r"\.dylib$"), "native_macho").when(low.rlike(r"\.a$"), "static_archive")
            .when(low.rlike(r"\.ko(\.gz)?$|\.so(\.\d+)*$"), "native_elf"))


def type_by_magic(data: Column) -> Column:
    """Artifact type told by the first bytes, else null for archives and the rest."""
    magic = F.hex(F.substring(data, 1, 8))

    def begins(prefix: str) -> Column:
        return F.startswith(magic, F.lit(prefix))

    macho = F.substring(magic, 1, 8).isin(grades.MACHO_MAGICS)
    return (F.when(begins(grades.ELF_MAGIC), "native_elf").when(macho, "native_macho")
            .when(begins("4D5A"), "native_pe").when(magic == "213C617263683E0A", "static_archive")
            .when(begins("EDABEEDB"), "rpm"))


def artifact_types(artifacts: DataFrame, members: DataFrame) -> DataFrame:
    """(artifact_id, artifact_name, artifact_type): by name, first bytes, then members."""
    path = F.col("file_path")

    def holds(pattern: str) -> Column:
        return F.bool_or((F.col("jar") == "") & path.rlike(pattern))

    inside = members.groupBy("artifact_id").agg(
        holds(r"(^|/)METADATA$").alias("wheel"), F.bool_or(path.rlike(r"^([^/]+/)*classes\.jar(/|$)")).alias("aar"),
        holds(r"(^|/)classes\.dex$").alias("apk"), holds(r"\.nuspec$").alias("nuspec"),
        holds(r"pom\.xml$").alias("pom"), holds(r"^manifest\.json$").alias("image"),
        holds(r"(PKG-INFO|setup\.py)$").alias("sdist"))
    name = F.lower("artifact_name")
    is_zip = F.startswith(F.hex(F.substring("content", 1, 2)), F.lit("504B"))
    is_tar = F.hex(F.substring("content", 1, 2)) == "1F8B"
    is_tar = is_tar | (F.hex(F.substring("content", 258, 5)) == "7573746172")
    zip_type = (F.when(F.col("wheel"), "python_wheel").when(F.col("aar"), "android_aar")
                .when(F.col("apk"), "android_apk").when(F.col("nuspec"), "nuget")
                .when(F.col("pom"), "java_jar").when(F.col("wheel").isNotNull(), "zip_generic"))
    tar_type = (F.when(F.col("image"), "container_image").when(F.col("sdist"), "python_sdist")
                .when(name.rlike(r"\.(tar\.gz|tgz)$"), "python_sdist"))
    found = artifacts.select("artifact_id", "artifact_name", type_by_name(F.col("artifact_name")).alias("by_name"),
                             type_by_magic(F.col("content")).alias("by_magic"), is_zip.alias("is_zip"),
                             is_tar.alias("is_tar")).join(inside.hint("merge"), "artifact_id", "left")  # a row per archive
    return found.select("artifact_id", "artifact_name", F.coalesce(
        "by_name", "by_magic", F.when(F.col("is_zip"), zip_type), F.when(F.col("is_tar"), tar_type),
        F.lit("unknown")).alias("artifact_type"))
