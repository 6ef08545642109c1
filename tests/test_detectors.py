"""Detectors on small inputs, and what is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from cipherledger import schema
from cipherledger.operators import detect_binary, detect_config, detect_endpoints, detect_manifests, detect_text
from cipherledger.sources.files import with_names
from tests.conftest import places


def rules(findings):
    return sorted(r["rule_id"] for r in findings.select("rule_id").collect())


def test_ssh(make_files):
    found = detect_config.detect_ssh(make_files({
        "etc/sshd_config": "# Ciphers des\n\n  Ciphers aes128-cbc, 3DES-CBC\nMACs = hmac-md5\nPort 22\n",
        "etc/other_config": "Ciphers des\n",
    }))
    assert places(found) == [
        ("etc/sshd_config", 3, "ssh-weak-ciphers-3des-cbc"), ("etc/sshd_config", 3, "ssh-weak-ciphers-aes128-cbc"),
        ("etc/sshd_config", 4, "ssh-weak-macs-hmac-md5"),
    ]
    severities = {r["rule_id"]: r["severity"] for r in found.collect()}
    assert severities["ssh-weak-macs-hmac-md5"] == "critical"  # high in source code
    assert severities["ssh-weak-ciphers-aes128-cbc"] == "medium"


def test_tls_lines_are_true_lines(make_files):
    """Comment lines, blank lines and continuations do not shift the line."""
    text = (
        "# one\n# two\nserver {\n\n\n  ssl_protocols TLSv1 TLSv1.2;\n  # ssl_protocols SSLv3;\n"
        "  ssl_ciphers HIGH:\\\nDES-CBC3-SHA:\\\n!RC4;\n}\nSSLProtocol all -SSLv3 +TLSv1.1\nssl-default-bind-options sslv2\n"
    )
    assert places(detect_config.detect_tls(make_files({"a/nginx.conf": text}))) == [
        ("a/nginx.conf", 6, "tls-weak-protocol-tlsv1"), ("a/nginx.conf", 8, "tls-weak-cipher-3des-des-cbc3-sha"),
        ("a/nginx.conf", 12, "tls-weak-protocol-tlsv1.1"), ("a/nginx.conf", 13, "tls-weak-protocol-sslv2"),
    ]


def test_tls_first_pattern_decides(make_files):
    text = "SSLCipherSuite NULL-MD5:EXP-RC4-MD5:DES-CBC-SHA:DES-CBC3-MD5:RC4-MD5:AES128-MD5:AES256-SHA"
    assert rules(detect_config.detect_tls(make_files({"a.conf": text}))) == sorted([
        "tls-weak-cipher-des-null-md5", "tls-weak-cipher-des-exp-rc4-md5", "tls-weak-cipher-des-des-cbc-sha",
        "tls-weak-cipher-3des-des-cbc3-md5", "tls-weak-cipher-rc4-rc4-md5", "tls-weak-cipher-md5-aes128-md5",
    ])


@pytest.mark.parametrize("name, text, expected", [
    ("requirements.txt", "# rsa\n-r x\nPyCrypto==1\n python.jose[x] ; y\nflask\n", [(3, "DEP-PY-PYCRYPTODOME"), (4, "DEP-PY-JWT")]),
    ("Pipfile", "rsa='*'\n[packages]\n\"rsa\" = '*'\n#ecdsa = 1\n[other]\necdsa = 1\n[dev-packages]\nbcrypt='1'\n",
     [(3, "DEP-PY-RSA"), (8, "DEP-PY-BCRYPT")]),
    ("pyproject.toml", "[project]\ndependencies = [\n 'rsa>=1',\n \"flask\",\n]\n'ecdsa'\noptional-dependencies.x = [\n'ecdsa'\n[tool]\n'rsa'\n",
     [(3, "DEP-PY-RSA"), (8, "DEP-PY-ECDSA")]),
    # a version with = ends the list before the line is read
    ("setup.cfg", "[options]\ninstall_requires = rsa\n  ecdsa\n  bcrypt>=1\n  paramiko\n", [(2, "DEP-PY-RSA"), (3, "DEP-PY-ECDSA")]),
])
def test_python_manifests(make_files, name, text, expected):
    found = places(detect_manifests.detect_python_manifests(make_files({f"p/{name}": text})))
    assert [(n, r) for _, n, r in found] == expected


def test_package_json(make_files):
    found = places(detect_manifests.detect_node_manifests(make_files({
        "a/package.json": '{\n "name": "x",\n "dependencies": {"jose": "1", "b": {"c": 1}},\n "devDependencies": {\n  "bcryptjs": null\n },\n "peerDependencies": []\n}',
        "b/package.json": '{"dependencies": {"jose": "1"',
        "c/package.json": '["jose"]',
        "d/package.json": '{"dependencies": {"jose": "1", "jose": "2"}}',
    })))
    assert found == [("a/package.json", 3, "DEP-NODE-JOSE"), ("a/package.json", 5, "DEP-NODE-BCRYPT"), ("d/package.json", 1, "DEP-NODE-JOSE")]


def test_java_keeps_one_per_rule(make_files):
    pom = (
        "<dependency>\n<groupId>org.bouncycastle</groupId>\n<artifactId>a</artifactId>\n</dependency>\n"
        "<dependency>\n<groupId>org.bouncycastle</groupId>\n</dependency>\n<dependency>\n<artifactId>java-jwt</artifactId>\n</dependency>\n"
    )
    gradle = "implementation 'org.bouncycastle:x:1'\napi group: 'org.jasypt', name: 'y'\ncompile \"com.auth0:java-jwt:3\"\n"
    assert places(detect_manifests.detect_java_manifests(make_files({"pom.xml": pom, "build.gradle": gradle}))) == [
        ("build.gradle", 1, "DEP-JAVA-BOUNCYCASTLE"), ("build.gradle", 2, "DEP-JAVA-JASYPT"), ("build.gradle", 3, "DEP-JAVA-JWT"),
        ("pom.xml", 1, "DEP-JAVA-BOUNCYCASTLE"), ("pom.xml", 8, "DEP-JAVA-JWT"),
    ]


def test_go_mod(make_files):
    text = "require (\n\tgolang.org/x/crypto v1\n\t// golang.org/x/crypto v0\n)\nrequire github.com/golang-jwt/jwt/v5 v5\nrequire golang.org/x/crypto\n"
    assert [(n, r) for _, n, r in places(detect_manifests.detect_go_manifests(make_files({"go.mod": text})))] == [
        (2, "DEP-GO-XCRYPTO"), (5, "DEP-GO-GOLANGJWT")
    ]


def test_lazy_patterns_may_span_resources(make_files):
    text = 'resource "tls_private_key" "a" {\n}\nresource "other" "b" {\n  algorithm = "RSA"\n}\nrsa_bits = 1024 rsa_bits = 1024\n'
    found = detect_text.detect_terraform(make_files({"m.tf": text}))
    assert places(found) == [("m.tf", 1, "IAC-TF-TLS-RSA"), ("m.tf", 6, "IAC-TF-RSA-1024"), ("m.tf", 6, "IAC-TF-RSA-1024")]
    rsa = found.where("rule_id = 'IAC-TF-RSA-1024'").first()
    assert rsa["algorithm"]["key_size"] is None  # so no key-size requirement applies


def test_document_routes(make_files):
    files = make_files({
        "a.yaml": "AWS::X\nhosts: a\nvalidate_certs: no\nKeySpec: RSA_2048\n",
        "b.yml": "hosts: a\nkind: Certificate\nvalidate_certs: no\n",
        "Dockerfile": "RUN openssl genrsa 1024\n",
        "x/Dockerfile.prod": "COPY a.pem /\n",
    })
    assert rules(detect_text.detect_cloudformation(files)) == ["IAC-CFN-KMS-RSA"]
    assert rules(detect_text.detect_ansible(files)) == ["IAC-ANS-NO-CERT-VALID"]
    assert rules(detect_text.detect_kubernetes(files)) == ["CTR-K8S-CERTMGR"]
    assert rules(detect_text.detect_dockerfile(files)) == ["CTR-DOCKER-EMBED-CERTS", "CTR-DOCKER-GENRSA", "CTR-DOCKER-GENRSA-1024"]


def binaries(spark, contents):
    rows = [(path, len(raw), bytearray(raw)) for path, raw in contents.items()]
    return with_names(spark.createDataFrame(rows, "path string, length long, content binary"))


def test_binary_strings_and_symbols(spark):
    files = binaries(spark, {"a.so": b"\xff\xfe" * 40 + b"OpenSSL 1.1 RSA_generate_key_ex EVP_sha1x", "b.so": b"MD5_Init", "c.txt": b"MD5_Init" * 20})
    strings = detect_binary.detect_strings(files)
    assert places(strings) == [("a.so", 80, "BIN-STR-OPENSSL"), ("a.so", 92, "BIN-STR-RSA-KEYGEN")]
    assert strings.where("rule_id = 'BIN-STR-OPENSSL'").first()["location"]["line_content"] == "offset 0x50: OpenSSL 1.1"
    assert places(detect_binary.detect_symbols(files)) == [("a.so", 0, "BIN-SYM-RSA-KEYGEN")]


def test_entropy_regions(spark):
    hot, cold = bytes(range(256)), b"ab" * 128
    edge = bytes(range(128)) + bytes(range(128, 192)) * 2  # exactly 7.5 bits
    found = detect_binary.detect_entropy(binaries(spark, {
        "few.bin": hot + cold * 4 + hot, "all.bin": hot * 8, "edge.bin": edge + cold * 3, "short.bin": hot, "many.bin": (hot + cold * 2) * 8,
    }))
    by_path = {}
    for path, offset, _ in places(found):
        by_path.setdefault(path, []).append(offset)
    # the last block is never looked at
    assert by_path == {"few.bin": [0], "edge.bin": [0], "many.bin": [0, 768, 1536, 2304, 3072, 3840, 4608, 5376]}


def test_certificates(spark):
    rows = [
        ("a.pem", 0, "RSA", 1024, None, "1.2.840.113549.1.1.4", None, "cn", None),
        ("a.pem", 1, "EC", 384, "secp384r1", "1.2.840.113549.1.1.12", None, None, None),
        ("b.pem", 0, "Ed25519", None, None, "9.9", "sha224", "x", None),
        ("b.pem", 1, "RSA", 8192, None, "9.9", None, "x", None),
    ]
    found = detect_endpoints.detect_certificates(spark.createDataFrame(rows, schema.CERTIFICATES))
    assert places(found) == [
        ("a.pem", 1, "CERT-PK-RSA-1024"), ("a.pem", 1, "CERT-SIG-MD5"), ("a.pem", 2, "CERT-PK-ECC-P384"), ("b.pem", 1, "CERT-SIG-SHA-256"),
        ("b.pem", 2, "CERT-PK-RSA-generic"),
    ]  # SHA-384 has no algorithm row
    severities = {r["rule_id"]: r["severity"] for r in found.collect()}
    assert severities["CERT-SIG-MD5"] == "critical" and severities["CERT-SIG-SHA-256"] == "low"


def test_tls_endpoint(spark):
    row = [("h", 443, "TLSv1.0", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "RSA", 1024, None, "sha1")]
    found = detect_endpoints.detect_tls_endpoints(spark.createDataFrame(row, schema.ENDPOINTS))
    assert rules(found) == sorted([
        "NET-TLS-TLSv10", "NET-CIPHER-DES", "NET-CIPHER-3DES", "NET-NO-PFS", "NET-RSA-KEX", "NET-CERT-RSA", "NET-CERT-SIG-SHA1",
    ])  # a 3DES suite is a DES suite by name as well
    assert found.where("rule_id = 'NET-CERT-RSA'").first()["severity"] == "critical"


def test_call_sites_first_kind_wins(spark):
    rows = [("a.py", 1, "rsa.generate_private_key", 1024, " x "), ("a.py", 2, "ec.generate_private_key", None, "y"), ("a.py", 3, "print", None, "")]
    found = detect_endpoints.detect_calls(spark.createDataFrame(rows, schema.CALLS))
    assert places(found) == [("a.py", 1, "AST-PY-RSA-1024"), ("a.py", 2, "AST-PY-ECC-GEN")]
    first = found.where("rule_id = 'AST-PY-RSA-1024'").first()
    assert (first["confidence"], first["severity"], first["algorithm"]["key_size"]) == (0.95, "critical", 1024)


def test_targets(spark):
    targets = ["a:22", "b", "c:x", "[::1]:8443", "d:"]
    host, port = detect_endpoints.host_and_port(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in targets], "t string").select(host.alias("h"), port.alias("p")).collect()
    assert [(r["h"], r["p"]) for r in rows] == [("a", 22), ("b", 443), ("c:x", 443), ("[::1]", 8443), ("d:", 443)]


def test_pem_blocks(spark):
    text = "-----BEGIN CERTIFICATE-----\nlost\n-----BEGIN CERTIFICATE-----\nA\n-----END CERTIFICATE-----\nx\n-----BEGIN CERTIFICATE-----\nB\n-----END CERTIFICATE-----\n"
    rows = detect_endpoints.split_pem(spark.createDataFrame([("p", text)], "path string, content string")).collect()
    assert [(r["cert_index"], r["pem"].split("\n")[1]) for r in rows] == [(0, "A"), (1, "B")]
