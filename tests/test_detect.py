from __future__ import annotations

import random
import re

from tests.conftest import rows

from keyfathom.dims import grades, signals
from keyfathom.dims.registry import REGISTRY
from keyfathom.functions import patterns as pt
from keyfathom.operators import agility, detect

FILES = "repo_id string, file_path string, content string"


def brute_force(text: str) -> set[tuple[str, int]]:
    """Line of the start of every match of every pattern in the whole text."""
    found = set()
    for a in REGISTRY:
        for p in a.patterns:
            for m in re.finditer(p, text, re.I | re.M):
                found.add((a.name, text.count("\n", 0, m.start()) + 1))
    return found


PIECES = ["MD5", "MD5_Init(", "\n", " ", "hashlib.sha1", "sha-1", "RSA_generate_key(r,", "1024", "2048", ");", ";", "AES", "_128",
          "-128", "3DES", "Cipher.getInstance('DES", "KeyPairGenerator", "x = ", "TLSv1", ".2", ".", "_method", "ssh-keygen ", "-b ",
          "-t rsa", "-t dsa", "openssl", "  genrsa", "ML-KEM-768", "mlkem512", "kyber1024", "Dilithium3", "--pbkdf", "=pbkdf2",
          "KexAlgorithms ", "ecdh-sha2-nistp256", "'RS256'", '"', "Blowfish", "bf-cbc", "SPHINCS+", "slh_dsa", "aes-xts-plain",
          "curve_public_key", " = '", "$KEYGEN ", "-----BEGIN PRIVATE KEY-----", "PBKDF2", "wc_AesSetKey(a,", " 16", "\r\n",
          "\u0001", "ECDSA", "ecdhe-rsa-", "X25519", ",", "rc4", "default_bits", "mbedtls_aes_setkey_enc(a, b,", "128"]


def random_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_equals_whole_text_matching(spark):
    texts = random_texts(600)
    files = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], FILES).repartition(8)
    got = {(int(p), a, n) for p, a, n in detect.code_hits(files, ["file_path"]).collect()}
    plain = {(int(p), a, n) for p, a, n in detect.code_hits(files, ["file_path"], guarded=False).collect()}
    want = {(i, a, n) for i, t in enumerate(texts) for a, n in brute_force(re.sub("\r\n?", "\n", t))}
    assert want
    assert got == want
    assert plain == want


def test_every_pattern_is_guarded():
    for a in REGISTRY:
        assert pt.guard_tokens(a.patterns)
    for pattern, *_ in grades.NATIVE_SYMBOLS:
        assert pt.guard_tokens([pattern], fold=False)
    for row in [*signals.AGILITY_SIGNALS, *signals.HYBRID_SIGNALS]:
        assert pt.guard_tokens([row[0]])


def test_required_runs():
    assert pt.required_runs(r"\bMD5_(?:Init|Final)\s*\(") == ["md5_", "("]
    assert pt.required_runs(r"EVP_des_ede3?_") == ["evp_des_ede", "_"]
    assert pt.required_runs(r"AES.{0,5}128") == ["aes", "128"]
    assert pt.alternatives(r"a(b|c)|d[|]|e\|f") == ["a(b|c)", "d[|]", r"e\|f"]


def test_spans_lines():
    assert pt.spans_lines(r"a\s*b") and pt.spans_lines(r"a[^;]*b") and not pt.spans_lines(r"a[^'\n]*b.c")


def test_multi_line_hit_belongs_to_first_line(table):
    files = table(FILES, ("r", "a.c", "a\nRSA_generate_key(r,\n 1024)"))
    assert rows(detect.code_hits(files), "algorithm", "line_number") == [("RSA-1024", 2)]


def test_one_hit_per_line(table):
    files = table(FILES, ("r", "a.c", "MD5 MD5_Init(x)\nMD5"))
    assert rows(detect.code_hits(files), "algorithm", "line_number") == [("MD5", 1), ("MD5", 2)]


def test_context_window(table):
    lines = [f"line {n}" for n in range(1, 31)]
    lines[14] = "x = MD5"
    found = detect.code_findings(table(FILES, ("r", "src/a.py", "\n".join(lines) + "\n"))).first()
    assert found.context_start_line == 6
    assert found.context.split("\n") == lines[5:26]
    assert (found.line_number, found.risk_level, found.quantum_safe, found.in_test_path) == (15, "CRITICAL", False, False)


def test_context_at_the_ends(table):
    files = table(FILES, ("r", "tests/a.py", "MD5\nb\nc\n"))
    found = detect.code_findings(files).first()
    assert (found.context, found.context_start_line, found.in_test_path) == ("MD5\nb\nc", 1, True)


def test_source_file_selection(table):
    files = table(FILES, *[("r", p, "") for p in (
        "src/a.py", "a.PY", "node_modules/x.js", "src/vendor.go", "vendor/x.go", "etc/sshd_config", "README.md", ".env", "build/a.c", "a.c++")])
    assert rows(detect.source_files(files), "file_path") == [
        ("a.PY",), ("a.c++",), ("etc/sshd_config",), ("src/a.py",), ("src/vendor.go",)]


def _levels(table, files, critical_paths=()):
    frame = table(FILES, *[("r", p, t) for p, t in files])
    found = table("repo_id string, file_path string, risk_level string",
                  *([("r", p, "CRITICAL") for p in critical_paths] or [("none", "x", "LOW")]))
    return agility.agility_levels(frame, agility.signal_rows(frame), found).first()


def test_agility_caps_and_anchors(table):
    strong = "alg_negotiate\nCryptoRegistry\nregister_algorithm\nalg_fallback"
    assert _levels(table, [("a.py", strong)]).agility_level == 5
    capped = _levels(table, [("a.py", strong)], ["a.py"] * 3)
    assert (capped.agility_level, capped.agility_score) == (3, 9)
    assert "3 CRITICAL findings" in capped.cap_notice
    assert _levels(table, [("a.py", strong)], ["a.py"] * 10).agility_level == 2
    assert _levels(table, [("a.py", strong)], ["tests/a.py"] * 10).agility_level == 5
    keyed = _levels(table, [("a.py", strong + "\n-----BEGIN RSA PRIVATE KEY-----")])
    assert (keyed.agility_score, keyed.agility_level) == (0, 1)
    both = _levels(table, [("a.py", "HybridKEM\n-----BEGIN RSA PRIVATE KEY-----")])
    assert (both.agility_score, both.has_hybrid) == (3, True)
    assert _levels(table, [("a.py", "RSA.generate(1024)\n" + strong)]).agility_score == 2
    assert _levels(table, [("tests/a.py", strong)]).agility_score == 0


def test_scheduling_is_not_cryptography(table):
    files = table(FILES, ("r", "a.py", "LoadSchedulingAlgorithm config algorithm\nalgorithm config"))
    assert rows(agility.agility_signals(files), "line_number", "weight") == [(2, 1)]
