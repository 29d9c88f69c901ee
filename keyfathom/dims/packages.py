"""Curated packages that expose quantum-vulnerable cryptography."""

from __future__ import annotations

# ---- FIXED VALUES ----------------------------------------------------------

# (ecosystem, name, algorithm, algo_type, vulnerable_below, risk_level,
#  quantum_status, nist_replacement, reason); no threshold means every version.
CURATED_PACKAGES = [
    ("pypi", "cryptography", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Widely-used crypto library — provides RSA/ECDSA/AES/TLS primitives, all quantum-vulnerable; no PQC support yet"),
    ("pypi", "pyopenssl", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "PyOpenSSL wraps OpenSSL RSA/ECDSA/TLS — all quantum-vulnerable algorithms exposed"),
    ("pypi", "python-jose", "JWT-RS256", "Signature", "3.3.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Versions < 3.3.0 had algorithm confusion (CVE-2022-29217); RS256/RS512 JWT signing is quantum-vulnerable"),
    ("pypi", "authlib", "JWT-RS256", "Signature", "1.2.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "OAuth2/OIDC library using RSA-based JWT — quantum-vulnerable; versions < 1.2.0 had validation issues"),
    ("pypi", "jwcrypto", "JWT-RS256", "Signature", "1.5.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "JWE/JWS/JWT library using RSA/ECDSA — quantum-vulnerable"),
    ("pypi", "pycrypto", "RSA-2048", "Asymmetric", None, "CRITICAL", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Abandoned library (last release 2014); implements RSA/DES/MD5 — quantum-vulnerable with known CVEs"),
    ("pypi", "pycryptodome", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Provides RSA/ECDSA/DES/MD5 — all quantum-vulnerable; migrate to post-quantum primitives"),
    ("pypi", "pyjwt", "JWT-RS256", "Signature", "2.4.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Versions < 2.4.0 default to RS256 (RSA-based JWT signing) — quantum-vulnerable"),
    ("pypi", "paramiko", "RSA-2048", "Asymmetric", "3.0.0", "HIGH", "VULNERABLE",
     "ML-KEM-768 hybrid (FIPS 203)",
     "Versions < 3.0.0 use RSA/DSA host key algorithms by default in SSH connections"),
    ("pypi", "pydes", "DES", "Symmetric", None, "CRITICAL", "BROKEN", "AES-256-GCM",
     "Implements DES/3DES — classically broken cipher, quantum-vulnerable"),
    ("pypi", "m2crypto", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "M2Crypto wraps OpenSSL RSA/DSA/ECDSA/TLS — all quantum-vulnerable algorithms exposed"),
    ("pypi", "rsa", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Pure-Python RSA implementation — quantum-vulnerable; no PQC support"),
    ("pypi", "ecdsa", "ECDSA", "Signature", None, "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Pure-Python ECDSA implementation — quantum-vulnerable elliptic curve signatures"),
    ("pypi", "pyotp", "SHA-1", "Hash", None, "HIGH", "WEAK", "TOTP with SHA-256 (RFC 6238)",
     "Uses HMAC-SHA1 by default for TOTP generation — SHA-1 is quantum-weak"),
    ("npm", "jsonwebtoken", "JWT-RS256", "Signature", "9.0.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Versions < 9.0.0 defaulted to RS256 and had CVE-2022-23529; RS256 is quantum-vulnerable"),
    ("npm", "node-forge", "RSA-2048", "Asymmetric", "1.3.0", "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203)",
     "Versions < 1.3.0 had RSA verification bypass (CVE-2022-0122); all versions use quantum-vulnerable RSA"),
    ("npm", "md5", "MD5", "Hash", None, "CRITICAL", "BROKEN", "SHA-3-256",
     "MD5 hash — classically broken (collision attacks) and quantum-vulnerable"),
    ("npm", "sha1", "SHA-1", "Hash", None, "HIGH", "WEAK", "SHA-3-256",
     "SHA-1 hash — weakened by SHAttered attack; quantum-weak"),
    ("npm", "crypto-js", "MD5", "Hash", "4.2.0", "HIGH", "VULNERABLE", "SHA-3-256 / AES-256-GCM",
     "Versions < 4.2.0 include MD5/SHA1/DES implementations and weak PRNG"),
    ("npm", "des.js", "DES", "Symmetric", None, "CRITICAL", "BROKEN", "AES-256-GCM",
     "Implements DES/3DES — classically broken cipher"),
    ("npm", "jsrsasign", "RSA-2048", "Asymmetric", "10.5.25", "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Versions < 10.5.25 had signature verification bypass; all versions use quantum-vulnerable RSA/ECDSA"),
    ("maven", "bcprov-jdk15on", "RSA-2048", "Asymmetric", "1.70", "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Bouncy Castle < 1.70 has known CVEs; all versions provide quantum-vulnerable RSA/ECDSA"),
    ("maven", "bcprov-jdk18on", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Bouncy Castle provides quantum-vulnerable RSA/ECDSA — use PQC extensions"),
    ("maven", "nimbus-jose-jwt", "JWT-RS256", "Signature", "9.37.2", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Versions < 9.37.2 had parsing vulnerabilities; RS256 default is quantum-vulnerable"),
    ("maven", "jose4j", "JWT-RS256", "Signature", "0.9.4", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "JWT library using RSA-based signing — quantum-vulnerable"),
    ("maven", "jasypt", "MD5", "Hash", "1.9.3", "HIGH", "VULNERABLE", "Argon2id / AES-256-GCM",
     "Versions < 1.9.3 default to MD5-based encryption; weak key derivation"),
    ("go", "github.com/dgrijalva/jwt-go", "JWT-RS256", "Signature", None, "CRITICAL", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Abandoned (CVE-2020-26160); uses RSA-based JWT signing — quantum-vulnerable. Migrate to github.com/golang-jwt/jwt/v5"),
    ("go", "github.com/golang-jwt/jwt", "JWT-RS256", "Signature", "4.5.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Versions < 4.5.0 had algorithm confusion vulnerability; RS256 is quantum-vulnerable"),
    ("crates.io", "md5", "MD5", "Hash", None, "CRITICAL", "BROKEN", "SHA-3-256",
     "MD5 hash implementation — classically broken and quantum-vulnerable"),
    ("crates.io", "sha1", "SHA-1", "Hash", None, "HIGH", "WEAK", "SHA-3-256",
     "SHA-1 hash implementation — weakened by SHAttered attack"),
    ("crates.io", "rsa", "RSA-2048", "Asymmetric", "0.9.6", "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203)",
     "Versions < 0.9.6 had timing side-channel (RUSTSEC-2023-0071); all versions quantum-vulnerable"),
    ("crates.io", "des", "DES", "Symmetric", None, "CRITICAL", "BROKEN", "AES-256-GCM",
     "DES cipher implementation — classically broken"),
    ("pypi", "twisted", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Twisted TLS/SSL uses OpenSSL RSA/ECDSA under the hood — quantum-vulnerable; no PQC support"),
    ("pypi", "fabric", "RSA-2048", "Asymmetric", None, "HIGH", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Fabric uses Paramiko for SSH — RSA/ECDSA key exchange is quantum-vulnerable"),
    ("pypi", "invoke", "RSA-2048", "Asymmetric", None, "MEDIUM", "VULNERABLE", "ML-KEM-768 (FIPS 203) / ML-DSA-65 (FIPS 204)",
     "Invoke (Fabric dependency) may invoke SSH via Paramiko — quantum-vulnerable key exchange"),
    ("pypi", "httplib2", "RSA-2048", "Asymmetric", "0.22.0", "HIGH", "VULNERABLE",
     "httpx with TLS 1.3 / ML-KEM post-quantum TLS",
     "httplib2 < 0.22.0 had SSRF and cert validation issues; TLS transport uses RSA/ECDSA — quantum-vulnerable"),
    ("pypi", "bcrypt", "Blowfish", "Symmetric", None, "MEDIUM", "WEAK", "Argon2id (quantum-safe KDF)",
     "bcrypt uses Blowfish cipher — Grover's algorithm halves effective key strength; migrate to Argon2id for password hashing"),
    ("pypi", "passlib", "Blowfish", "Symmetric", "1.7.4", "MEDIUM", "WEAK", "Argon2id (quantum-safe KDF)",
     "passlib bcrypt backend uses Blowfish — quantum-weak; upgrade to Argon2id handler"),
    ("pypi", "itsdangerous", "HMAC-SHA1", "Signature", "2.0.0", "MEDIUM", "WEAK",
     "HMAC-SHA256 / ML-DSA-65 (FIPS 204)",
     "Versions < 2.0.0 default to HMAC-SHA1 for token signing — SHA-1 is quantum-weak"),
    ("pypi", "django", "PBKDF2-SHA256", "Symmetric", "4.2.0", "MEDIUM", "WEAK",
     "Argon2id (quantum-safe KDF) — enable django.contrib.auth.hashers.Argon2PasswordHasher",
     "Django < 4.2 defaults to PBKDF2-SHA256 for password hashing; Argon2id is the quantum-safe alternative"),
    ("pypi", "flask", "HMAC-SHA1", "Signature", "2.3.0", "MEDIUM", "WEAK",
     "HMAC-SHA256 / ML-DSA-65 (FIPS 204)",
     "Flask < 2.3 session cookies signed with HMAC-SHA1 via Werkzeug — quantum-weak"),
    ("npm", "bcrypt", "Blowfish", "Symmetric", None, "MEDIUM", "WEAK", "Argon2id (quantum-safe KDF)",
     "bcrypt uses Blowfish cipher — Grover's algorithm halves effective key strength; migrate to Argon2id"),
    ("npm", "bcryptjs", "Blowfish", "Symmetric", None, "MEDIUM", "WEAK", "Argon2id (quantum-safe KDF)",
     "bcryptjs uses Blowfish cipher — quantum-weak symmetric; migrate to Argon2id"),
    ("npm", "passport", "JWT-RS256", "Signature", "0.6.0", "HIGH", "VULNERABLE", "ML-DSA-65 (FIPS 204)",
     "Passport.js < 0.6.0 had session fixation; JWT strategy uses RSA-based RS256 — quantum-vulnerable"),
]

# An advisory mentioning any of these is about cryptography.
ADVISORY_KEYWORDS = [
    "cryptograph", "cipher", "encrypt", "decrypt", "hash", "digest",
    "tls", "ssl", "rsa", "ecdsa", "ecdh", "aes", "des", "md5", "sha-1",
    "sha1", "key exchange", "certificate", "jwt", "signature", "pkcs",
    "quantum", "post-quantum", "hmac", "pbkdf", "kdf", "diffie",
]

# First text fragment found in an advisory decides its algorithm.
ADVISORY_ALGORITHMS = [
    ("rsa", "RSA-2048"),
    ("ecdsa", "ECDSA"),
    ("md5", "MD5"),
    ("sha-1", "SHA-1"),
    ("sha1", "SHA-1"),
    ("des", "DES"),
    ("rc4", "RC4"),
    ("tls", "TLS-1.2"),
    ("jwt", "JWT-RS256"),
]
ADVISORY_DEFAULT_ALGORITHM = "RSA-2048"
ADVISORY_REPLACEMENT = "See NIST PQC standards (FIPS 203/204/205)"
ADVISORY_DEFAULT_SUMMARY = "Crypto vulnerability detected"

# Advisory feed ecosystem name -> ecosystem used here.
FEED_ECOSYSTEMS = {
    "PyPI": "pypi",
    "npm": "npm",
    "Go": "go",
    "crates.io": "crates.io",
    "Maven": "maven",
    "RubyGems": "rubygems",
}

CVE_PATTERN = r"CVE-\d{4}-\d+"

# ---- END OF FIXED VALUES ---------------------------------------------------

COLUMNS = [
    "ecosystem", "name", "algorithm", "algo_type", "vulnerable_below", "risk_level",
    "quantum_status", "nist_replacement", "reason",
]
