from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from keyfathom.operators import dependencies, manifests, native
from keyfathom.plans.scans import scan_artifacts
from keyfathom.sources import archives

FILES = "repo_id string, file_path string, content string"


@pytest.mark.parametrize("name, text, expected", [
    ("requirements.txt", "A[x]==1.0,<2\n# no\n-r more.txt\n\nb >= 2.1 ; python_version < '3'\nhttp://x\nC_d.e~=3 # hi\nbare\n",
     [("a", "1.0"), ("b", "2.1"), ("c_d.e", "3"), ("bare", "")]),
    ("dev/requirements-dev.TXT", "x==1\r\ny\r\n", [("x", "1"), ("y", "")]),
    ("Pipfile", "flask == 1.0\n", [("flask", "1.0")]),
    ("pyproject.toml", "name = 'svc'\n  indented = \"1\"\njwt = \"^1.7.0,<2\"\nt = {version = \"1\"}\n", [("name", ""), ("jwt", "1.7.0")]),
    ("package.json", json.dumps({"dependencies": {"MD5": "^2.3.0 || 3"}, "peerDependencies": {"md5": "1"}}), [("md5", "2.3.0"), ("md5", "1")]),
    ("package.json", "{broken", []),
    ("go.mod", "module x\nrequire github.com/a/b v1.0\nrequire (\n\tgithub.com/C/d v2.3.4+incompatible\n)\n", [("github.com/c/d", "2.3.4+incompatible")]),
    ("Cargo.toml", "[package]\nmd5 = \"1\"\n[dependencies]\nrsa = \"0.9\"\n# c\nx = { git = \"u\", version = '2' }\n[dev-dependencies]\nsha1 = '1'\n[other]\nz = \"1\"\n",
     [("rsa", "0.9"), ("x", "2"), ("sha1", "1")]),
    ("pom.xml", "<project xmlns=\"u\"><dependency>\n<exclusions><exclusion><artifactId>no</artifactId></exclusion></exclusions><artifactId>jose4j</artifactId>"
     "<version>${v}1.2-x</version></dependency><dependency><groupId>g</groupId></dependency></project>", [("jose4j", "1.2")]),
    ("Gemfile.lock", "GEM\n  specs:\n    jwt (2.1)\n      dep (~> 1)\n    Rake (13)\n", [("jwt", "2.1"), ("rake", "13")]),
])
def test_manifests(table, name, text, expected):
    got = manifests.parse(table(FILES, ("r", name, text))).orderBy("ord").collect()
    assert [(r.name, r.version) for r in got] == expected


def test_skipped_folders_and_other_files(table):
    files = table(FILES, ("r", "node_modules/a/package.json", '{"dependencies":{"md5":"1"}}'), ("r", "setup.cfg", "x==1"))
    assert manifests.parse(files).count() == 0


def test_first_mention_wins(table):
    schema = "repo_id string, manifest string, ord int, ecosystem string, name string, version string"
    packages = table(schema, ("r", "m", 2, "pypi", "pyjwt", "1.0"), ("r", "m", 1, "PyPI", "PyJWT", "2.0"), ("r", "m", 3, "pypi", "paramiko", "9.0"),
                     ("r", "m", 4, "pypi", "authlib", "1.0"))
    got = dependencies.dependency_findings(packages)
    assert rows(got, "dependency_name", "dependency_version", "algorithm") == [("PyJWT", "2.0", "JWT-RS256"), ("authlib", "1.0", "JWT-RS256")]
    assert dependencies.artifact_findings(packages).select("dependency_name").collect() == [("PyJWT",)]
    assert "PyJWT==2.0" in got.where("dependency_name = 'PyJWT'").first().context


def _tar(members: dict[str, bytes], mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


ELF = b"\x7fELF\x02\x00\x00MD5_Init\x00padding RSA_sign here\x00"
ARTIFACTS = {
    "image.tar.gz": _tar({
        "l2/layer.tar": _tar({"app/requirements.txt": b"pyjwt==9.0\nflask==1.0\n"}),
        "l1/layer.tar": _tar({"app/requirements.txt": b"pyjwt==1.0\n", "usr/lib/libx.so": ELF}),
        "manifest.json": json.dumps([{"Layers": ["l1/layer.tar", "l2/layer.tar"]}]).encode()}, "w:gz"),
    "fat.jar": _zip({"META-INF/pom.xml": b"<dependency><artifactId>jose4j</artifactId><version>0.9.0</version></dependency>",
                     "b/B.class": b"\x00javax/crypto/Cipher\x00", "a/A.class": b"\x00java/security/Signature\x00",
                     "lib/inner.jar": _zip({"C.class": b"\x00javax/crypto/KeyAgreement\x00"})}),
    "x.gem": _tar({"metadata.gz": gzip.compress(b"name: x\ndependencies:\n  name: jwt\n"), "data.tar.gz": _tar({"ext/native.so": ELF}, "w:gz")}),
    "tool.bin": b"not an archive",
    "plain.zip": _zip({"src/text.md": b"hello", "bin/tool": ELF}),
}


@pytest.fixture
def artifacts(spark):
    return spark.createDataFrame([(n, n, bytearray(c)) for n, c in ARTIFACTS.items()],
                                 "artifact_id string, artifact_name string, content binary")


def test_unpack(artifacts):
    got = {(r.artifact_id, r.jar, r.layer, r.file_path) for r in archives.unpack(artifacts).collect()}
    assert ("image.tar.gz", "", 0, "usr/lib/libx.so") in got
    assert ("image.tar.gz", "", 1, "app/requirements.txt") in got
    assert ("fat.jar", "lib/inner.jar", None, "lib/inner.jar/C.class") in got
    assert ("x.gem", "", None, "ext/native.so") in got
    assert ("tool.bin", "", None, "") in got


def test_artifact_types(artifacts):
    got = dict(archives.artifact_types(artifacts, archives.unpack(artifacts)).select("artifact_id", "artifact_type").collect())
    assert got == {"image.tar.gz": "container_image", "fat.jar": "java_jar", "x.gem": "ruby_gem", "tool.bin": "unknown", "plain.zip": "zip_generic"}


def test_scan_artifacts(artifacts):
    got = scan_artifacts(artifacts)
    assert rows(got, "file_path", "algorithm", "dependency_version") == sorted([
        ("fat.jar/META-INF/pom.xml", "JWT-RS256", "0.9.0"),
        ("fat.jar/a/A.class", "RSA-2048", ""),
        ("fat.jar/lib/inner.jar/C.class", "RSA-2048", ""),
        ("image.tar.gz/app/requirements.txt", "HMAC-SHA1", "1.0"),
        ("image.tar.gz/app/requirements.txt", "JWT-RS256", "1.0"),
        ("image.tar.gz/usr/lib/libx.so", "MD5", ""),
        ("image.tar.gz/usr/lib/libx.so", "RSA-2048", ""),
        ("plain.zip/bin/tool", "MD5", ""),
        ("plain.zip/bin/tool", "RSA-2048", ""),
        ("x.gem/ext/native.so", "MD5", ""),
        ("x.gem/ext/native.so", "RSA-2048", "")], key=lambda r: tuple((True, v) for v in r))


def test_printable_runs(table):
    data = table("d binary", (bytearray(b"\x00short\x01longer text\xff\x7fanother one\n"),))
    assert data.select(native.printable_text(F.col("d")).alias("t")).first().t == "longer text\nanother one"


def test_symbols_are_case_sensitive_and_first_pattern_wins(table):
    members = table("id int, text string", (1, "md5_init gcry_pk_sign RSA_verify DES"), (2, "rsa_sign"))
    assert rows(native.symbol_hits(members), "id", "algorithm", "symbol") == [(1, "DES", "DES"), (1, "RSA-2048", "RSA_verify")]


def test_advisory_severity(table):
    one = table("severity array<string>", (["CVSS:3.1/AV:N", "7.5"],), (["CVSS:3.1"],), ([],), (["x", "y"],))
    assert [r.s for r in one.select(dependencies.cvss_score(F.col("severity")).alias("s")).collect()] == [7.5, 3.1, None, None]
