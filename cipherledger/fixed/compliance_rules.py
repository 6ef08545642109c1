"""Conditions of fourteen compliance frameworks."""

# Fixed values -------------------------------------------------------------

ASYM = ["RSA", "ECC", "ECDSA", "ECDH", "DSA", "DH"]
BROKEN = ["DES", "3DES", "RC4"]
HASH = ["MD5", "SHA-1"]
NC = "non_compliant"
AR = "action_required"
V = ["vulnerable"]
VW = ["vulnerable", "weakened"]

# (framework, requirement, families or [], risks or [], key size below, status, deadline, description)
# {family} and {algorithm} stand for the finding's own values.
REQUIREMENTS = [
    ("NIST", "SP 800-131A", ["RSA"], [], 2048, NC, None, "RSA key sizes below 2048 bits are disallowed"),
    ("NIST", "SP 800-208", ["RSA"], [], None, AR, None, "Plan migration to PQC algorithms"),
    ("NIST", "SP 800-208", ["ECC", "DSA", "DH", "ECDH", "ECDSA"], [], None, AR, None, "Asymmetric algorithms vulnerable to quantum"),
    ("NIST", "SP 800-131A", ["DES", "3DES"], [], None, NC, None, "DES and 3DES are disallowed"),
    ("NIST", "SP 800-131A", ["MD5"], [], None, NC, None, "MD5 is not approved for digital signatures"),
    ("NIST", "SP 800-131A", ["SHA-1"], [], None, NC, None, "SHA-1 is disallowed for digital signatures"),
    ("EU PQC Roadmap", "INV-2026-Q4", [], VW, None, AR, "2026-12-31", "Complete cryptographic inventory by Q4 2026"),
    ("EU PQC Roadmap", "MIG-2030", ASYM, [], None, AR, "2030-12-31", "Migrate critical infrastructure to PQC by 2030"),
    ("ENS", "CCN-STIC-807", ["RSA"], [], 2048, NC, None, "Requires minimum RSA-2048 (CCN-STIC-807)"),
    ("ENS", "CCN-STIC-807-HASH", HASH, [], None, NC, None, "Hash functions MD5 and SHA-1 not approved for nivel alto"),
    ("ENS", "CCN-STIC-807-CIPHER", BROKEN, [], None, NC, None, "Cipher not approved in the cryptographic catalog"),
    ("ISO 27001", "A.8.24", [], VW, None, AR, None, "Use of cryptography — algorithm is quantum-vulnerable; documented cryptographic policy required"),
    ("ISO 27001", "A.8.24.1", ["RSA"], [], 2048, NC, None, "Key management — RSA key size below 2048 bits"),
    ("ISO 27001", "A.8.24.1", ["DES", "3DES", "MD5", "SHA-1"], [], None, NC, None, "Key management — {family} is no longer considered secure"),
    ("PCI DSS v4.0", "Req 4.2.1", ASYM, [], None, AR, None, "Strong cryptography for data-in-transit — asymmetric algorithm is quantum-vulnerable"),
    ("PCI DSS v4.0", "Req 4.2.1", BROKEN + HASH, [], None, NC, None, "Strong cryptography for data-in-transit — {family} is not considered strong cryptography"),
    ("PCI DSS v4.0", "Req 3.5.1", ["DES", "3DES"], [], None, NC, None, "Protect stored data — {family} is not acceptable for data protection"),
    ("PCI DSS v4.0", "Req 3.5.1", ["AES"], ["weakened"], None, NC, None, "Protect stored data — AES with quantum-weakened key size"),
    ("GDPR", "Art 32.1.a", [], V, None, AR, None, 'Encryption as appropriate measure — algorithm is quantum-vulnerable; "state of the art" requires planning PQC migration'),
    ("GDPR", "Art 32.1.a", BROKEN + HASH, [], None, NC, None, 'Encryption as appropriate measure — {family} is no longer "state of the art"'),
    ("HIPAA", "164.312(a)(2)(iv)", BROKEN, [], None, NC, None, "Encryption and decryption — {family} does not meet encryption standard requirements"),
    ("HIPAA", "164.312(e)(2)(ii)", ASYM, [], None, AR, None, "Encryption for data in transit — asymmetric algorithm is quantum-vulnerable"),
    ("DORA", "Art 6.2", [], V, None, AR, "2025-01-17", "ICT risk management — algorithm is quantum-vulnerable; risk assessment required"),
    ("DORA", "Art 6.2", BROKEN + HASH, [], None, NC, "2025-01-17", "ICT risk management — {family} is classically broken and non-compliant"),
    ("NIS2", "Art 21.2.e", [], V, None, AR, "2024-10-17", "Cryptographic controls — algorithm is quantum-vulnerable; migration planning required"),
    ("NIS2", "Art 21.2.e", BROKEN + HASH, [], None, NC, "2024-10-17", "Cryptographic controls — {family} is classically broken and non-compliant"),
    ("eIDAS 2.0", "Art 32", ASYM, V, None, AR, "2027-12-31", "Qualified electronic signatures using quantum-vulnerable algorithms require migration plan"),
    ("eIDAS 2.0", "Art 32.1", ["RSA", "ECC", "DSA", "ECDSA"], [], None, NC, "2027-12-31", "{family} signatures will not meet qualified signature requirements post-quantum"),
    ("eIDAS 2.0", "Art 24.2", BROKEN, [], None, NC, None, "{family} is not acceptable for trust service security"),
    ("eIDAS 2.0", "Art 32.1", HASH, [], None, NC, None, "{family} is not acceptable for qualified electronic signatures"),
    ("SOC 2", "CC6.1", BROKEN + HASH, [], None, NC, None, "Logical access controls using weak cryptography ({family})"),
    ("SOC 2", "CC6.1", ASYM, V, None, AR, None, "Logical access controls use quantum-vulnerable cryptography"),
    ("SOC 2", "CC6.7", [], V, None, AR, None, "Data-in-transit protection using quantum-vulnerable algorithm ({algorithm})"),
    ("SOC 2", "CC6.7", BROKEN, [], None, NC, None, "Data-in-transit protection using broken cipher ({family})"),
    ("BSI", "TR-02102-1 Sec 3.5", ["RSA"], [], 3072, AR, None, "RSA key size below 3072 bits; BSI recommends minimum 3072-bit RSA"),
    ("BSI", "TR-02102-1 Sec 3.2", BROKEN, [], None, NC, None, "{family} is not recommended by BSI"),
    ("BSI", "TR-02102-1 Sec 4.1", HASH, [], None, NC, None, "{family} is not recommended by BSI for cryptographic purposes"),
    ("BSI", "TR-02102-1 Sec 3.6", ASYM, V, None, AR, "2030-12-31", "Quantum-vulnerable asymmetric algorithm; BSI recommends PQC migration planning"),
    ("ANSSI", "RGS-B1", ["RSA"], [], 2048, NC, None, "RSA key size below 2048 bits is non-compliant with ANSSI recommendations"),
    ("ANSSI", "ANSSI-PQC-2024", ASYM, V, None, AR, "2030-12-31", "Quantum-vulnerable asymmetric algorithm requires PQC migration per ANSSI guidance"),
    ("ANSSI", "RGS-B1", BROKEN, [], None, NC, None, "{family} is not approved by ANSSI for any security purpose"),
    ("ANSSI", "RGS-B1", HASH, [], None, NC, None, "{family} is not approved by ANSSI for cryptographic hashing"),
    ("CNSS", "CNSSP-15 Sec 7", ASYM, V, None, AR, "2030-12-31", "Quantum-vulnerable asymmetric algorithm in national security system requires PQC transition"),
    ("CNSS", "CNSSP-15 Sec 6", BROKEN, [], None, NC, None, "{family} is not approved for use in national security systems"),
    ("CNSS", "CNSSP-15 Sec 6", HASH, [], None, NC, None, "{family} is not approved for use in national security systems"),
]
