"""Fixed values for agility scoring, path classes and file selection."""

from __future__ import annotations

# ---- FIXED VALUES ----------------------------------------------------------

# Lines naming an algorithm that has nothing to do with cryptography.
NON_CRYPTO_LINE = (
    r"LoadSchedulingAlgorithm|RoutingAlgorithm|SortingAlgorithm|"
    r"CompressionAlgorithm|CachingAlgorithm|LoadBalanc|Scheduling"
)

# (pattern, weight, description)
AGILITY_SIGNALS = [
    (r"alg_negotiat|AlgorithmNegotiat|negotiateAlgorithm", 4,
     "Algorithm negotiation detected (L5)"),
    (r"HybridKEM|hybrid_kem|X25519MLKEM|X25519Kyber|hybrid.*pqc|pqc.*hybrid", 3,
     "Hybrid KEM detected (L4)"),
    (r"ML[-_]?KEM|MLKEM|kyber|dilithium|ML[-_]?DSA|MLDSA|CRYSTALS", 3,
     "PQC algorithm in use (L4+)"),
    (r"mlkem|ml_kem|fips[-_]?203|fips[-_]?204", 3, "NIST FIPS 203/204 in use"),
    (r"CryptoRegistry|CryptoProvider|AlgorithmRegistry|AlgorithmProvider", 2,
     "Crypto registry pattern (L3)"),
    (r"registerAlgorithm|register_algorithm|registry\.get\(", 2, "Algorithm registry usage (L3)"),
    (r"algorithm.*config|config.*algorithm|crypto.*config|CRYPTO_ALGO", 1,
     "Config-driven algorithm (L2)"),
    (r"alg_fallback|algorithm_fallback|fallback.*alg", 1, "Fallback algorithm defined (L2)"),
    (r"-----BEGIN RSA PRIVATE KEY-----|-----BEGIN EC PRIVATE KEY-----", -3,
     "Hardcoded private key (L1 signal)"),
    (r"RSA\.generate\(1024|RSA\.generate\(512", -2, "Weak hardcoded RSA size (L1 signal)"),
]

# Negative signals that limit the score whatever else is found.
KEY_ANCHOR = "Hardcoded private key (L1 signal)"
WEAK_RSA_ANCHOR = "Weak hardcoded RSA size (L1 signal)"

# (pattern, description)
HYBRID_SIGNALS = [
    (r"X25519.*ML[-_]?KEM|ML[-_]?KEM.*X25519", "X25519+ML-KEM hybrid KEM"),
    (r"HybridKEM|hybrid_kem", "Hybrid KEM implementation"),
    (r"X25519Kyber|Kyber.*X25519", "X25519+Kyber hybrid (pre-FIPS)"),
    (r"classical.*pqc|pqc.*classical", "Classical+PQC hybrid pattern"),
    (r"CRYSTALS.*Dilithium|Dilithium.*CRYSTALS", "CRYSTALS-Dilithium (pre-FIPS ML-DSA)"),
    (r"kyber512|kyber768|kyber1024", "Kyber KEM (pre-FIPS ML-KEM)"),
    (r"dilithium2|dilithium3|dilithium5", "Dilithium signature (pre-FIPS ML-DSA)"),
    (r"SPHINCS\+|sphincsplus|slh.dsa", "SLH-DSA / SPHINCS+ signature"),
    (r"alg_fallback.*RS256|RS256.*alg_fallback", "JWT PQC+RSA fallback"),
    (r"TLS_KYBER|kyber.*tls|tls.*kyber", "TLS Kyber hybrid"),
]

AGILITY_LABELS = {1: "Hardcoded", 2: "Configurable", 3: "Hot-Swap", 4: "Hybrid", 5: "Fully Agile"}

TEST_PATH = (
    r"(^|/)test[s_]?/|/spec/|_test\.|_spec\.|test_|spec_"
    r"|\.test\.|\.spec\.|/mock/|/mocks/|/fixture/|/fixtures/"
    r"|/examples?/|/sample/|/demo/|/docs?/"
)
VENDOR_PATH = (
    r"(^|/)(vendor|third.?party|extern|generated|auto.?gen"
    r"|\.cache|node_modules|__pycache__|dist|build)/"
)

LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "java": [".java"],
    "go": [".go"],
    "typescript": [".ts", ".tsx"],
    "javascript": [".js", ".jsx", ".mjs"],
    "kotlin": [".kt", ".kts"],
    "rust": [".rs"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".h", ".hpp", ".hxx", ".h++", ".c"],
    "csharp": [".cs"],
    "dart": [".dart"],
    "ruby": [".rb"],
    "swift": [".swift"],
    "yaml": [".yml", ".yaml"],
    "config": [".conf", ".cfg", ".ini", ".toml", ".env"],
    "shell": [".sh", ".bash", ".zsh", ".ksh"],
}
SOURCE_FILE_NAMES = ["sshd_config", "ssh_config"]
SOURCE_SKIP_DIRS = [
    ".git", "node_modules", "__pycache__", ".venv", "venv",
    "dist", "build", ".next", "vendor", "target",
]

MANIFEST_NAMES = [
    "requirements.txt", "pyproject.toml", "Pipfile", "package.json",
    "go.mod", "Cargo.toml", "pom.xml", "Gemfile.lock",
]
MANIFEST_SKIP_DIRS = [
    ".git", "node_modules", "__pycache__", "vendor", "dist", "build", ".tox", "venv", ".venv",
]

# ---- END OF FIXED VALUES ---------------------------------------------------

SOURCE_EXTENSIONS = [ext for exts in LANGUAGE_EXTENSIONS.values() for ext in exts]
