"""Scores, break years, effort, replacements, vendors, reports."""

# Fixed values -------------------------------------------------------------

# grade -> lowest score
GRADES = [("A", 90.0), ("B", 75.0), ("C", 60.0), ("D", 40.0)]
LOWEST_GRADE = "F"
ADVANCED_MULTIPLIER = {"critical": 3.0, "high": 1.5, "medium": 1.0, "low": 0.5, "info": 0.0}

# quantum vulnerability score
QVSS_RISK = {"vulnerable": 9.0, "weakened": 5.0, "safe": 0.0, "unknown": 3.0}
QVSS_TIMELINE = {"vulnerable": 7.0, "weakened": 4.0, "safe": 0.0, "unknown": 3.0}
# family -> (key strength, patch availability); others 5.0 and 5.0
QVSS_FAMILY = {
    "RSA": (7.0, 6.0),
    "ECC": (6.5, 6.0),
    "ECDSA": (6.5, 6.0),
    "ECDH": (6.5, 6.0),
    "DSA": (7.5, 7.0),
    "DH": (7.0, 6.0),
    "DES": (9.5, 9.0),
    "3DES": (8.0, 9.0),
    "RC4": (9.5, 9.0),
    "Blowfish": (7.0, 9.0),
    "MD5": (9.5, 9.0),
    "SHA-1": (8.0, 9.0),
    "AES": (3.0, 8.0),
    "ChaCha20": (2.0, 5.0),
    "SHA-2": (1.0, 5.0),
    "SHA-3": (0.5, 5.0),
}
QVSS_LABELS = [("Critical", 9.0), ("High", 7.0), ("Medium", 4.0), ("Low", 0.1)]

# debt
DEBT_WEIGHT = {"asymmetric_vulnerable": 10.0, "symmetric_weakened": 3.0, "classically_broken": 8.0, "hash_deprecated": 5.0}
DEBT_SEVERITY = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5, "info": 0.1}

# (threshold, logical qubits, break year optimistic, moderate, conservative, attack, confidence)
BREAK_YEARS = [
    ("RSA-1024", 1500, 2028, 2032, 2038, "Shor's algorithm", "high"),
    ("RSA-2048", 4000, 2030, 2035, 2040, "Shor's algorithm", "medium"),
    ("RSA-4096", 8000, 2033, 2038, 2045, "Shor's algorithm", "medium"),
    ("ECC-256", 2500, 2029, 2034, 2040, "Shor's algorithm", "medium"),
    ("ECC-384", 3500, 2030, 2035, 2042, "Shor's algorithm", "medium"),
    ("DSA", 3000, 2030, 2035, 2040, "Shor's algorithm", "medium"),
    ("DH", 4000, 2030, 2035, 2040, "Shor's algorithm", "medium"),
    ("AES-128", 2953, 2040, 2050, 2060, "Grover's algorithm (halves key strength to 64-bit)", "low"),
]
THRESHOLD_BY_KEY = [
    ("RSA", 1024, "RSA-1024"),
    ("RSA", 2048, "RSA-2048"),
    ("RSA", 4096, "RSA-4096"),
    ("ECC", 256, "ECC-256"),
    ("ECC", 384, "ECC-384"),
]
THRESHOLD_BY_FAMILY = {
    "RSA": "RSA-2048",
    "ECC": "ECC-256",
    "ECDSA": "ECC-256",
    "ECDH": "ECC-256",
    "DSA": "DSA",
    "DH": "DH",
    "AES": "AES-128",
}
SENSITIVITY_WEIGHT = {"public": 0.2, "internal": 0.5, "confidential": 0.8, "top_secret": 1.0}

# (family, usage, hours)
BASE_HOURS = [
    ("RSA", "library_call", 8), ("RSA", "tls_config", 4), ("RSA", "certificate", 6), ("RSA", "key_management", 16), ("RSA", "custom_implementation", 40),
    ("ECC", "library_call", 8), ("ECC", "tls_config", 4), ("ECC", "certificate", 6), ("ECC", "key_management", 16), ("ECC", "custom_implementation", 40),
    ("ECDSA", "library_call", 8), ("ECDSA", "tls_config", 4), ("ECDSA", "certificate", 6), ("ECDSA", "key_management", 16), ("ECDSA", "custom_implementation", 40),
    ("ECDH", "library_call", 8), ("ECDH", "tls_config", 4), ("ECDH", "key_management", 16), ("ECDH", "custom_implementation", 40),
    ("DSA", "library_call", 6), ("DSA", "tls_config", 4), ("DSA", "certificate", 6), ("DSA", "key_management", 12), ("DSA", "custom_implementation", 32),
    ("DH", "library_call", 8), ("DH", "tls_config", 4), ("DH", "key_management", 16), ("DH", "custom_implementation", 40),
    ("DES", "library_call", 2), ("DES", "tls_config", 2), ("DES", "custom_implementation", 8),
    ("3DES", "library_call", 2), ("3DES", "tls_config", 2), ("3DES", "custom_implementation", 8),
    ("AES", "library_call", 2), ("AES", "tls_config", 1), ("AES", "custom_implementation", 4),
    ("RC4", "library_call", 2), ("RC4", "tls_config", 2), ("RC4", "custom_implementation", 8),
    ("Blowfish", "library_call", 2), ("Blowfish", "custom_implementation", 6),
    ("MD5", "library_call", 1), ("MD5", "custom_implementation", 4),
    ("SHA-1", "library_call", 1), ("SHA-1", "custom_implementation", 4),
]
DEFAULT_HOURS = 4
# most files -> effort multiplier; beyond the last it is 3.0
FILE_MULTIPLIER = [(5, 1.0), (20, 1.5), (50, 2.0)]
MANY_FILES_MULTIPLIER = 3.0
# most hours -> complexity; beyond the last it is critical
COMPLEXITY = [(2, "low"), (8, "medium"), (24, "high")]
MOST_COMPLEX = "critical"

# family -> [(purpose, replacement)], first one is the headline
REPLACEMENTS = {
    "RSA": [("signatures", "ML-DSA-65 (FIPS 204)"), ("key_exchange", "ML-KEM-768 (FIPS 203)"), ("encryption", "ML-KEM-768 + AES-256-GCM")],
    "ECC": [("signatures", "ML-DSA-44 (FIPS 204)"), ("key_exchange", "ML-KEM-512 (FIPS 203)")],
    "ECDSA": [("signatures", "ML-DSA-44 (FIPS 204)")],
    "ECDH": [("key_exchange", "ML-KEM-512 (FIPS 203)")],
    "DSA": [("signatures", "ML-DSA-44 (FIPS 204)")],
    "DH": [("key_exchange", "ML-KEM-768 (FIPS 203)")],
    "DES": [("encryption", "AES-256-GCM")],
    "3DES": [("encryption", "AES-256-GCM")],
    "RC4": [("encryption", "AES-256-GCM or ChaCha20-Poly1305")],
    "Blowfish": [("encryption", "AES-256-GCM")],
    "MD5": [("hashing", "SHA-256 or SHA-3-256")],
    "SHA-1": [("hashing", "SHA-256 or SHA-3-256")],
}
DEFAULT_REPLACEMENT = "PQC equivalent"

# (severity, risk) -> priority, others 3; priority -> phase
PRIORITY = {
    ("critical", "vulnerable"): 1,
    ("high", "vulnerable"): 1,
    ("critical", "weakened"): 2,
    ("medium", "vulnerable"): 2,
    ("high", "weakened"): 2,
    ("low", "vulnerable"): 3,
    ("medium", "weakened"): 3,
    ("low", "weakened"): 4,
    ("info", "vulnerable"): 4,
    ("info", "weakened"): 5,
}
DEFAULT_PRIORITY = 3
PHASE_OF_PRIORITY = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
PHASES = [
    (1, "Critical Infrastructure"),
    (2, "Core Business Systems"),
    (3, "Supporting Systems"),
    (4, "Optimization"),
]
HOURS_PER_MONTH = 160
HOURLY_RATE = 150.0

# usage -> vendor; others OpenSource
VENDOR_BY_USE = {
    "hsm": "PQShield",
    "embedded": "PQShield",
    "iot": "PQShield",
    "low_latency": "PQShield",
    "hardware": "PQShield",
    "fips": "PQShield",
    "government": "PQShield",
    "defense": "PQShield",
    "tls": "QuSecure",
    "network": "QuSecure",
    "orchestration": "QuSecure",
    "hybrid": "QuSecure",
    "cloud": "QuSecure",
    "enterprise": "QuSecure",
    "vpn": "QuSecure",
    "development": "OpenSource",
    "testing": "OpenSource",
    "research": "OpenSource",
    "non_critical": "OpenSource",
    "budget": "OpenSource",
    "library_call": "OpenSource",
}
# vendor -> (description, best for)
VENDORS = {
    "PQShield": ("Hardware-focused PQC solutions provider", ["HSM upgrades", "Embedded/IoT devices", "Low-latency applications", "Government/defense"]),
    "QuSecure": ("Network-focused PQC orchestration platform", ["TLS/network infrastructure", "Enterprise-wide orchestration", "Hybrid transition management", "Cloud environments"]),
    "OpenSource": ("Open-source PQC implementations", ["Development and testing", "Non-critical systems", "Budget-constrained deployments", "Research and experimentation"]),
}

# reports: severity -> (level, numeric security severity)
SARIF_SEVERITY = {
    "critical": ("error", "9.5"),
    "high": ("error", "7.5"),
    "medium": ("warning", "5.0"),
    "low": ("note", "2.5"),
    "info": ("note", "1.0"),
}
SARIF_TAGS = ["security", "cryptography", "post-quantum"]
# detector -> asset type, others algorithm; asset type -> component type
ASSET_OF_DETECTOR = {"certificate": "certificate", "network": "protocol", "secrets": "key"}
COMPONENT_ASSET = {
    "algorithm": "algorithm",
    "key": "related-crypto-material",
    "certificate": "certificate",
    "protocol": "protocol",
}
PRIMITIVE = {
    "RSA": "pke",
    "ECC": "pke",
    "ECDSA": "signature",
    "ECDH": "key-agree",
    "DSA": "signature",
    "DH": "key-agree",
    "AES": "ae",
    "DES": "block-cipher",
    "3DES": "block-cipher",
    "ChaCha20": "stream-cipher",
    "RC4": "stream-cipher",
    "Blowfish": "block-cipher",
    "MD5": "hash",
    "SHA-1": "hash",
    "SHA-2": "hash",
    "SHA-3": "hash",
    "ML-KEM": "kem",
    "ML-DSA": "signature",
    "SLH-DSA": "signature",
    "Random": "other",
    "Unknown": "unknown",
}
