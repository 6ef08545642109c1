"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_SS = T.ArrayType(_S)


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ALGORITHM = _struct(
    name=_S, family=_S, key_size=_I, quantum_risk=_S, pqc_replacements=_SS, eu_deadline=_S, description=_S
)
LOCATION = _struct(file_path=_S, line_number=_I, line_content=_S, context_before=_SS, context_after=_SS)

# Total order of findings: detector, path, then three detector-specific positions.
ORDER = _struct(detector=_I, path=_S, a=_L, b=_L, c=_L)

FINDING = _struct(
    rule_id=_S,
    severity=_S,
    quantum_risk=_S,
    algorithm=ALGORITHM,
    location=LOCATION,
    message=_S,
    recommendation=_S,
    compliance_refs=_SS,
    confidence=_D,
    scanner_type=_S,
    ord=ORDER,
)

FILES = _struct(path=_S, name=_S, suffix=_S, length=_L, content=_S)

RULE = _struct(
    rule_id=_S,
    language=_S,
    algorithm_key=_S,
    pattern=_S,
    message=_S,
    recommendation=_S,
    severity_override=_S,
    quantum_risk_override=_S,
    rule_ord=_I,
)

CERTIFICATES = _struct(
    path=_S, cert_index=_I, key_type=_S, key_size=_I, curve=_S, sig_oid=_S, sig_hash=_S, subject_cn=_S,
    not_after=T.DateType(),
)
ENDPOINTS = _struct(
    host=_S, port=_I, tls_version=_S, cipher=_S, key_type=_S, key_size=_I, curve=_S, sig_hash=_S
)
SSH_OFFERS = _struct(
    host=_S, port=_I, kex=_SS, hostkey=_SS, cipher_c2s=_SS, cipher_s2c=_SS, mac_c2s=_SS, mac_s2c=_SS
)
CALLS = _struct(path=_S, line=_I, func_name=_S, key_size=_I, line_content=_S)
SCANS = _struct(
    scan_id=_S, target=_S, ts=T.TimestampType(), score=_D, grade=_S, total_findings=_L, critical_count=_L,
    pqc_readiness_pct=_D,
)
