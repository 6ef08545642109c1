"""Severities, risks, families and the algorithm dimension."""

# Fixed values -------------------------------------------------------------

# (severity, order from most to least severe, score weight)
SEVERITIES = [
    ("critical", 0, 10.0),
    ("high", 1, 7.0),
    ("medium", 2, 4.0),
    ("low", 3, 1.5),
    ("info", 4, 0.0),
]

RISKS = ["vulnerable", "weakened", "safe", "unknown"]

# (name, family, key_size, quantum_risk, replacements, eu_deadline, description)
ALGORITHMS = [
    ("RSA-1024", "RSA", 1024, "vulnerable", ["ML-DSA-65", "ML-DSA-87", "SLH-DSA-SHA2-128s"], "2026-Q4", "RSA 1024-bit — broken classically, fully vulnerable to quantum"),
    ("RSA-2048", "RSA", 2048, "vulnerable", ["ML-DSA-65", "ML-DSA-87", "SLH-DSA-SHA2-128s"], "2030", "RSA 2048-bit — secure classically, vulnerable to quantum (Shor)"),
    ("RSA-4096", "RSA", 4096, "vulnerable", ["ML-DSA-65", "ML-DSA-87", "SLH-DSA-SHA2-128s"], "2030", "RSA 4096-bit — secure classically, vulnerable to quantum (Shor)"),
    ("RSA-generic", "RSA", None, "vulnerable", ["ML-DSA-65", "ML-DSA-87"], "2030", "RSA (unknown key size) — vulnerable to quantum (Shor)"),
    ("ECC-P256", "ECC", 256, "vulnerable", ["ML-DSA-44", "ML-DSA-65"], "2030", "ECC P-256 — vulnerable to quantum (Shor)"),
    ("ECC-P384", "ECC", 384, "vulnerable", ["ML-DSA-65", "ML-DSA-87"], "2030", "ECC P-384 — vulnerable to quantum (Shor)"),
    ("ECC-generic", "ECC", None, "vulnerable", ["ML-DSA-44", "ML-DSA-65"], "2030", "ECC (generic) — vulnerable to quantum (Shor)"),
    ("DSA-generic", "DSA", None, "vulnerable", ["ML-DSA-65", "ML-DSA-87"], "2030", "DSA — vulnerable to quantum (Shor)"),
    ("DH-generic", "DH", None, "vulnerable", ["ML-KEM-768", "ML-KEM-1024"], "2030", "Diffie-Hellman — vulnerable to quantum (Shor)"),
    ("ECDH-generic", "ECDH", None, "vulnerable", ["ML-KEM-512", "ML-KEM-768"], "2030", "ECDH — vulnerable to quantum (Shor)"),
    ("ECDSA-generic", "ECDSA", None, "vulnerable", ["ML-DSA-44", "ML-DSA-65"], "2030", "ECDSA — vulnerable to quantum (Shor)"),
    ("AES-128", "AES", 128, "weakened", ["AES-256"], None, "AES-128 — Grover reduces effective security to 64-bit"),
    ("AES-256", "AES", 256, "safe", [], None, "AES-256 — quantum safe (Grover reduces to 128-bit, still sufficient)"),
    ("DES", "DES", 56, "vulnerable", ["AES-256"], None, "DES — broken classically, trivially broken by quantum"),
    ("3DES", "3DES", 168, "vulnerable", ["AES-256"], None, "3DES — deprecated, vulnerable to quantum"),
    ("Blowfish", "Blowfish", None, "weakened", ["AES-256"], None, "Blowfish — 64-bit block, weakened by quantum"),
    ("RC4", "RC4", None, "vulnerable", ["AES-256", "ChaCha20-Poly1305"], None, "RC4 — broken classically, do not use"),
    ("MD5", "MD5", None, "vulnerable", ["SHA-3-256", "SHA-256"], None, "MD5 — broken, collision attacks trivial"),
    ("SHA-1", "SHA-1", None, "vulnerable", ["SHA-3-256", "SHA-256"], None, "SHA-1 — broken, SHAttered attack demonstrated"),
    ("SHA-256", "SHA-2", 256, "weakened", ["SHA-3-256"], None, "SHA-256 — Grover reduces collision resistance, still acceptable"),
    ("SHA-512", "SHA-2", 512, "safe", [], None, "SHA-512 — quantum safe for foreseeable future"),
    ("ML-KEM-512", "ML-KEM", None, "safe", [], None, "ML-KEM-512 (FIPS 203) — post-quantum KEM, NIST Level 1"),
    ("ML-KEM-768", "ML-KEM", None, "safe", [], None, "ML-KEM-768 (FIPS 203) — post-quantum KEM, NIST Level 3"),
    ("ML-KEM-1024", "ML-KEM", None, "safe", [], None, "ML-KEM-1024 (FIPS 203) — post-quantum KEM, NIST Level 5"),
    ("ML-DSA-44", "ML-DSA", None, "safe", [], None, "ML-DSA-44 (FIPS 204) — post-quantum signature, NIST Level 2"),
    ("ML-DSA-65", "ML-DSA", None, "safe", [], None, "ML-DSA-65 (FIPS 204) — post-quantum signature, NIST Level 3"),
    ("ML-DSA-87", "ML-DSA", None, "safe", [], None, "ML-DSA-87 (FIPS 204) — post-quantum signature, NIST Level 5"),
]

# severity a rule inherits from its algorithm's risk; no algorithm -> medium
SEVERITY_OF_RISK = {"vulnerable": "high", "weakened": "medium", "safe": "info", "unknown": "low"}

# detector order within one scan
DETECTORS = ["source", "certificate", "config", "dependency", "secrets", "network", "binary", "iac", "container"]

# presets: name -> (detectors, minimum severity, maximum file size in MB)
PROFILES = {
    "quick": (["source"], "high", 1),
    "standard": (["source", "certificate", "config", "dependency"], "info", 10),
    "deep": (["source", "certificate", "config", "dependency", "secrets", "iac"], "info", 50),
    "paranoid": (["source", "certificate", "config", "dependency", "secrets", "iac", "binary", "network"], "info", 100),
}
