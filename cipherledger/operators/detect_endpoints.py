"""Certificates, TLS and SSH endpoints, cipher suites, DNS, call sites.

Inputs are tables of observations (see schema.py): decoded certificate fields,
negotiated parameters, offered name lists, TLSA records, resolved calls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import endpoint_rules
from cipherledger.functions import text
from cipherledger.operators.findings import as_findings
from cipherledger.sources import rules as rule_tables

PEM_BLOCK = (
    r"(?s)(-----BEGIN CERTIFICATE-----(?:(?!-----BEGIN CERTIFICATE-----).)*?-----END CERTIFICATE-----)"
)


def split_pem(bundles: DataFrame) -> DataFrame:
    """One row per certificate block of a PEM bundle."""
    return bundles.select(
        "path", F.posexplode(F.regexp_extract_all("content", F.lit(PEM_BLOCK), F.lit(1))).alias("cert_index", "pem")
    )


def key_class(key_type: Column, key_size: Column, curve: Column) -> Column:
    """Algorithm key of a public key."""
    rsa = None
    for limit, name in endpoint_rules.RSA_KEY_CLASSES:
        fits = key_size <= limit
        rsa = F.when(fits, F.lit(name)) if rsa is None else rsa.when(fits, F.lit(name))
    return (
        F.when(key_type == "RSA", rsa.otherwise(F.lit("RSA-generic")))
        .when(key_type == "EC", F.coalesce(text.lookup(curve, endpoint_rules.CURVES), F.lit("ECC-generic")))
        .when(key_type == "DSA", F.lit("DSA-generic"))
    )


def signature_class(oid: Column, hash_name: Column) -> Column:
    """Algorithm key of a signature's hash: by OID, else by the hash's name."""
    by_name = None
    for token, key in endpoint_rules.SIGNATURE_HASHES.items():
        fits = F.contains(F.lower(hash_name), F.lit(token))
        by_name = F.when(fits, F.lit(key)) if by_name is None else by_name.when(fits, F.lit(key))
    return F.coalesce(text.lookup(oid, endpoint_rules.SIGNATURE_OIDS), by_name)


def detect_certificates(certificates: DataFrame) -> DataFrame:
    """Up to two findings per certificate: its key and its signature hash."""
    size = F.when(
        F.col("key_size").isNotNull() & (F.col("key_size") > 0), F.concat(F.lit(" ("), "key_size", F.lit("-bit)"))
    ).otherwise(F.lit(""))
    sides = F.array(
        F.struct(
            F.lit(0).alias("side"), F.lit("CERT-PK-").alias("prefix"),
            key_class(F.col("key_type"), F.col("key_size"), F.col("curve")).alias("algorithm_key"),
            F.lit("Public key").alias("what"), size.alias("extra"),
        ),
        F.struct(
            F.lit(1).alias("side"), F.lit("CERT-SIG-").alias("prefix"),
            signature_class(F.col("sig_oid"), F.col("sig_hash")).alias("algorithm_key"),
            F.lit("Signature hash").alias("what"), F.lit("").alias("extra"),
        ),
    )
    described = F.concat(
        F.lit("Certificate subject="), F.coalesce("subject_cn", F.lit("<unknown subject>")),
        F.lit(", expires="), F.coalesce(F.date_format("not_after", "yyyy-MM-dd"), F.lit("?")),
    )
    hits = (
        certificates.select("path", "cert_index", described.alias("described"), F.inline(sides))
        .join(F.broadcast(rule_tables.algorithms(certificates.sparkSession).select(
            F.col("name").alias("algorithm_key"), F.struct("*").alias("algorithm"))), "algorithm_key")
    )
    return as_findings(
        hits,
        scanner="certificate",
        path=F.col("path"),
        line_number=F.col("cert_index") + 1,
        line_content=F.col("described"),
        rule_id=F.concat("prefix", "algorithm_key"),
        severity=F.coalesce(text.lookup(F.col("algorithm_key"), endpoint_rules.CERTIFICATE_SEVERITY), F.lit("medium")),
        quantum_risk=F.col("algorithm.quantum_risk"),
        message=F.concat("what", F.lit(": "), "algorithm_key", "extra", F.lit(" | "), "described"),
        recommendation=F.when(
            F.size("algorithm.pqc_replacements") > 0,
            F.concat(F.lit("Reissue with "), F.array_join("algorithm.pqc_replacements", ", ")),
        ).otherwise(F.lit("Nothing to do: quantum-safe")),
        order=(F.col("cert_index"), F.col("side")),
    )


def host_and_port(target: Column) -> tuple[Column, Column]:
    """Host and port of ``host:port``; port 443 when absent or not a number."""
    given = F.substring_index(target, ":", -1)
    number = F.when(F.contains(target, F.lit(":")) & given.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(given).try_cast("int"))
    host = F.when(number.isNotNull(), F.substring(target, F.lit(1), F.length(target) - F.length(given) - 1)).otherwise(target)
    return host, F.coalesce(number, F.lit(443))


def _probe(rule_id, severity, name, family, detail, message, key_size=None, replacements=None) -> Column:
    """One candidate network finding as a struct; all branches share its shape."""
    return F.struct(
        rule_id.alias("rule_id"),
        severity.alias("severity"),
        rule_tables.own_algorithm(name, family, F.lit("vulnerable"), message, key_size, replacements).alias("algorithm"),
        detail.alias("detail"),
        message.alias("message"),
    )


def detect_tls_endpoints(endpoints: DataFrame) -> DataFrame:
    """Old versions, weak suites, no forward secrecy, keys and signatures."""
    version, suite = F.col("tls_version"), F.col("cipher")
    lit = F.lit
    checks = []
    for name, rule_id, severity in endpoint_rules.OLD_TLS_VERSIONS:
        checks.append(F.when(version == name, _probe(
            lit(rule_id), lit(severity), lit(name), lit("DH"), lit(f"Supports {name}"), lit(f"Endpoint accepts {name}"))))
    suite_detail = F.concat(lit("Cipher: "), suite)
    for word, severity, family, name in endpoint_rules.WEAK_SUITE_WORDS:
        checks.append(F.when(F.contains(F.upper(suite), lit(word)), _probe(
            lit(f"NET-CIPHER-{name.upper()}"), lit(severity), lit(name), lit(family), suite_detail,
            F.concat(lit("Endpoint negotiates "), suite))))
    secrecy = text.contains_any(suite, endpoint_rules.FORWARD_SECRECY_WORDS)
    checks.append(F.when(~secrecy, _probe(
        lit("NET-NO-PFS"), lit("medium"), lit("No-PFS"), lit("RSA"), suite_detail,
        F.concat(lit("No forward secrecy in "), suite))))
    rsa_exchange = F.contains(suite, lit("RSA")) & ~text.contains_any(suite, ["ECDHE", "DHE"])
    checks.append(F.when(rsa_exchange, _probe(
        lit("NET-RSA-KEX"), lit("high"), lit("RSA-KeyExchange"), lit("RSA"), suite_detail,
        F.concat(lit("RSA key exchange in "), suite))))
    key_type, size, curve = F.col("key_type"), F.col("key_size"), F.col("curve")
    rsa_name = F.concat(lit("RSA-"), size)
    checks.append(F.when(key_type == "RSA", _probe(
        lit("NET-CERT-RSA"), F.when(size < 2048, lit("critical")).otherwise(lit("high")), rsa_name, lit("RSA"),
        F.concat(lit("Certificate: "), rsa_name), F.concat(lit("Certificate key is "), rsa_name), size,
        F.array(lit("ML-DSA-65"), lit("ML-DSA-87")))))
    ecc_name = F.concat(lit("ECC-"), curve)
    checks.append(F.when(key_type == "EC", _probe(
        lit("NET-CERT-ECC"), lit("high"), ecc_name, lit("ECC"),
        F.concat(lit("Certificate: "), ecc_name), F.concat(lit("Certificate key is "), ecc_name), size,
        F.array(lit("ML-DSA-44"), lit("ML-DSA-65")))))
    checks.append(F.when(key_type == "DSA", _probe(
        lit("NET-CERT-DSA"), lit("critical"), lit("DSA"), lit("DSA"), lit("Certificate: DSA"), lit("Certificate key is DSA"))))
    signature = F.lower(F.col("sig_hash"))
    checks.append(F.when(signature.isin("md5", "sha1"), _probe(
        F.concat(lit("NET-CERT-SIG-"), F.upper(signature)), lit("critical"), F.upper(signature),
        F.when(signature == "md5", lit("MD5")).otherwise(lit("SHA-1")),
        F.concat(lit("Signature: "), F.col("sig_hash")), F.concat(lit("Certificate signed with "), F.col("sig_hash")))))

    hits = endpoints.select(
        F.concat_ws(":", "host", "port").alias("path"), F.posexplode(F.array(*checks)).alias("check_index", "hit")
    ).where(F.col("hit").isNotNull()).select("path", "check_index", "hit.*")
    return as_findings(
        hits,
        scanner="network",
        path=F.col("path"),
        line_number=F.lit(0),
        line_content=F.col("detail"),
        quantum_risk=F.lit("vulnerable"),
        recommendation=F.concat(F.lit("Phase out "), "algorithm.name", F.lit(" on this endpoint")),
        order=(0, F.col("check_index")),
    )


def offered_names(offers: DataFrame) -> DataFrame:
    """(path, list, name) of every name an SSH server offers; both directions count once (O3)."""
    lists = F.array(
        F.struct(F.lit(0).alias("list_index"), F.lit("KEX").alias("list"), F.col("kex").alias("names")),
        F.struct(F.lit(1).alias("list_index"), F.lit("HOSTKEY").alias("list"), F.col("hostkey").alias("names")),
        F.struct(F.lit(2).alias("list_index"), F.lit("CIPHER").alias("list"), F.array_union("cipher_c2s", "cipher_s2c").alias("names")),
        F.struct(F.lit(3).alias("list_index"), F.lit("MAC").alias("list"), F.array_union("mac_c2s", "mac_s2c").alias("names")),
    )
    return (
        offers.select(F.concat_ws(":", "host", "port").alias("path"), F.inline(lists))
        .select("path", "list_index", "list", F.posexplode("names").alias("index", "offered"))
    )


def detect_ssh_endpoints(offers: DataFrame) -> DataFrame:
    """Weak names among those offered in a key exchange."""
    table = rule_tables.table(
        offers.sparkSession, endpoint_rules.SSH_OFFERS,
        "list string, offered string, severity string, name string, family string, quantum_risk string",
    )
    hits = offered_names(offers).join(F.broadcast(table), ["list", "offered"])
    message = F.concat(F.lit("SSH server offers "), "offered")
    return as_findings(
        hits,
        scanner="network",
        path=F.col("path"),
        line_number=F.lit(0),
        line_content=F.concat(
            text.lookup(F.col("list"), {"KEX": "KEX", "HOSTKEY": "HostKey", "CIPHER": "Cipher", "MAC": "MAC"}),
            F.lit(": "), "offered",
        ),
        rule_id=F.concat(F.lit("NET-SSH-"), "list", F.lit("-"), F.replace(F.upper("name"), F.lit("-"), F.lit(""))),
        algorithm=rule_tables.own_algorithm(F.col("name"), F.col("family"), F.col("quantum_risk"), message),
        message=message,
        recommendation=F.concat(F.lit("Stop offering "), "offered"),
        order=(F.lit(1), F.col("list_index"), F.col("index")),
    )


def classify_suites(suites: DataFrame, column: str = "cipher") -> DataFrame:
    """Cipher-suite facts by name, with forward secrecy by name and quantum safety."""
    table = rule_tables.table(
        suites.sparkSession, endpoint_rules.CIPHER_SUITES,
        "suite string, key_exchange string, authentication string, bulk_cipher string, mac string, pfs boolean, "
        "quantum_risk string, risk_score double",
    )
    return (
        suites.join(F.broadcast(table), suites[column] == table["suite"], "left")
        .drop("suite")
        .withColumn("offers_pfs", F.upper(F.col(column)).rlike("ECDHE|DHE"))
        .withColumn("quantum_safe", F.lit(False))
    )


def detect_missing_dane(domains: DataFrame, tlsa_records: DataFrame) -> DataFrame:
    """Domains without a TLSA record."""
    missing = domains.select("domain").join(tlsa_records.select("domain"), "domain", "left_anti")
    return as_findings(
        missing,
        scanner="network",
        path=F.col("domain"),
        line_number=F.lit(0),
        line_content=F.lit("DNS"),
        rule_id=F.lit("NET-DNS-NO-DANE"),
        severity=F.lit("info"),
        quantum_risk=F.lit("unknown"),
        algorithm=rule_tables.own_algorithm(
            F.lit("DANE-Missing"), F.lit("Unknown"), F.lit("unknown"), F.lit("No DANE/TLSA records found")),
        message=F.concat(F.lit("No TLSA record for "), "domain"),
        recommendation=F.lit("Publish a TLSA record to pin the certificate"),
        order=(2,),
    )


def detect_calls(calls: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Call sites of key generators, broken hashes and weak random numbers.

    The first kind that fits decides. ``lines`` is optional and may bring
    context_before and context_after per (path, line).
    """
    name, size = F.col("func_name"), F.col("key_size")
    generates = F.contains(name, F.lit("generate_private_key"))

    def site(rule_id, severity, risk, family, algorithm, key_size=None):
        return F.struct(
            rule_id.alias("rule_id"), F.lit(risk).alias("quantum_risk"), severity.alias("severity"),
            rule_tables.own_algorithm(
                algorithm, F.lit(family), F.lit(risk), F.concat(algorithm, F.lit(" confirmed at a call site")), key_size
            ).alias("algorithm"),
        )

    high = F.lit("high")
    kind = (
        F.when(
            generates & F.contains(F.lower(name), F.lit("rsa")),
            F.when(size.isNotNull(), site(
                F.concat(F.lit("AST-PY-RSA-"), size), F.when(size < 2048, F.lit("critical")).otherwise(high),
                "vulnerable", "RSA", F.concat(F.lit("RSA-"), size), size,
            )).otherwise(site(F.lit("AST-PY-RSA-GEN"), high, "vulnerable", "RSA", F.lit("RSA-generic"))),
        )
        .when(generates & F.contains(F.lower(name), F.lit("ec")), site(F.lit("AST-PY-ECC-GEN"), high, "vulnerable", "ECC", F.lit("ECC-generic")))
        .when(name.isin("hashlib.md5", "md5"), site(F.lit("AST-PY-MD5"), high, "vulnerable", "MD5", F.lit("MD5")))
        .when(name.isin("hashlib.sha1", "sha1"), site(F.lit("AST-PY-SHA1"), high, "vulnerable", "SHA-1", F.lit("SHA-1")))
        .when(name.isin(endpoint_rules.WEAK_RANDOM_CALLS), site(F.lit("AST-PY-WEAK-RANDOM"), F.lit("medium"), "unknown", "Random", F.lit("WeakRandom")))
    )
    hits = calls.withColumn("kind", kind).where(F.col("kind").isNotNull())
    context = {}
    if lines is not None:
        around = lines.select("path", F.col("line_number").alias("line"), "context_before", "context_after")
        hits = hits.join(around, ["path", "line"], "left")
        context = dict(before=F.col("context_before"), after=F.col("context_after"))
    return as_findings(
        hits.select("*", "kind.rule_id", "kind.severity", "kind.quantum_risk", "kind.algorithm"),
        scanner="source",
        path=F.col("path"),
        line_number=F.col("line"),
        line_content=text.strip(F.col("line_content")),
        message=F.col("algorithm.description"),
        recommendation=F.concat(F.lit("Replace the call to "), "func_name"),
        confidence=endpoint_rules.CALL_CONFIDENCE,
        order=(F.col("line"), 1000),
        **context,
    )


def detect_network(endpoints: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """All network findings."""
    parts = [detect_tls_endpoints(endpoints)]
    if offers is not None:
        parts.append(detect_ssh_endpoints(offers))
    return reduce(DataFrame.unionByName, parts)
