"""SSH and TLS server settings, and dependency manifests."""

# Fixed values -------------------------------------------------------------

SSH_NAMES = ["sshd_config", "ssh_config"]
TLS_NAMES = ["nginx.conf", "httpd.conf", "apache2.conf", "haproxy.cfg"]
TLS_SUFFIXES = [".conf", ".cfg"]

# (directive, token, algorithm key)
SSH_TOKENS = [
    ("ciphers", "des", "DES"),
    ("ciphers", "des-cbc", "DES"),
    ("ciphers", "des-cbc@ssh.com", "DES"),
    ("ciphers", "3des", "3DES"),
    ("ciphers", "3des-cbc", "3DES"),
    ("ciphers", "3des-ctr", "3DES"),
    ("ciphers", "blowfish", "Blowfish"),
    ("ciphers", "blowfish-cbc", "Blowfish"),
    ("ciphers", "blowfish-ctr", "Blowfish"),
    ("ciphers", "rc4", "RC4"),
    ("ciphers", "arcfour", "RC4"),
    ("ciphers", "arcfour128", "RC4"),
    ("ciphers", "arcfour256", "RC4"),
    ("ciphers", "aes128-cbc", "AES-128"),
    ("ciphers", "aes128-ctr", "AES-128"),
    ("ciphers", "aes128-gcm@openssh.com", "AES-128"),
    ("macs", "hmac-md5", "MD5"),
    ("macs", "hmac-md5-96", "MD5"),
    ("macs", "hmac-md5-etm@openssh.com", "MD5"),
    ("macs", "hmac-md5-96-etm@openssh.com", "MD5"),
    ("macs", "hmac-sha1", "SHA-1"),
    ("macs", "hmac-sha1-96", "SHA-1"),
    ("macs", "hmac-sha1-etm@openssh.com", "SHA-1"),
    ("macs", "hmac-sha1-96-etm@openssh.com", "SHA-1"),
    ("macs", "umac-64", "SHA-1"),
    ("macs", "umac-64@openssh.com", "SHA-1"),
    ("macs", "umac-64-etm@openssh.com", "SHA-1"),
    ("kexalgorithms", "diffie-hellman-group1-sha1", "DH-generic"),
    ("kexalgorithms", "diffie-hellman-group14-sha1", "DH-generic"),
    ("kexalgorithms", "diffie-hellman-group-exchange-sha1", "DH-generic"),
    ("kexalgorithms", "ecdh-sha2-nistp256", "ECDH-generic"),
    ("hostkeyalgorithms", "ssh-dss", "DSA-generic"),
    ("hostkeyalgorithms", "ssh-rsa", "RSA-generic"),
    ("hostkeyalgorithms", "ecdsa-sha2-nistp256", "ECDSA-generic"),
]

# families that raise a vulnerable setting from high to critical
CRITICAL_IN_CONFIG = ["DES", "RC4", "MD5", "3DES"]

# (protocol token, severity)
WEAK_PROTOCOLS = [
    ("sslv2", "critical"),
    ("sslv3", "critical"),
    ("tlsv1", "high"),
    ("tlsv1.0", "high"),
    ("tlsv1.1", "high"),
]

# (pattern over one cipher name, algorithm key); the first that matches decides
WEAK_CIPHER_NAMES = [
    (r"(^|[-_])NULL([-_]|$)", "DES"),
    (r"(^|[-_])EXP(ORT)?([-_]|$)", "DES"),
    (r"(^|[-_:!])DES([-_]CBC|[-_]|$)(?!.*3)", "DES"),
    (r"(3DES|DES-CBC3|DES3)", "3DES"),
    (r"(RC4|ARCFOUR)", "RC4"),
    (r"([-_])MD5($|[-_])", "MD5"),
]

# (kind of value, directive pattern with the value in group 1)
TLS_DIRECTIVES = [
    ("protocols", r"^\s*ssl_protocols\s+(.+?)\s*;"),
    ("ciphers", r"""^\s*ssl_ciphers\s+['"]?(.+?)['"]?\s*;"""),
    ("protocols", r"^\s*SSLProtocol\s+(.+?)$"),
    ("ciphers", r"""^\s*SSLCipherSuite\s+['"]?(.+?)['"]?\s*$"""),
    ("ciphers", r"^\s*ssl-default-bind-ciphers\s+(.+?)$"),
    ("protocols", r"^\s*ssl-default-bind-options\s+(.+?)$"),
]

MANIFEST_NAMES = {
    "requirements.txt": "python",
    "pipfile": "python",
    "pyproject.toml": "python",
    "setup.cfg": "python",
    "package.json": "node",
    "pom.xml": "java",
    "build.gradle": "java",
    "build.gradle.kts": "java",
    "go.mod": "go",
}

# (rule_id, names, algorithm key, quantum_risk, severity)
PYTHON_LIBRARIES = [
    ("DEP-PY-PYCRYPTODOME", ["pycryptodome", "pycryptodomex", "pycrypto"], "RSA-generic", "vulnerable", "high"),
    ("DEP-PY-CRYPTOGRAPHY", ["cryptography"], "RSA-generic", "weakened", "medium"),
    ("DEP-PY-PARAMIKO", ["paramiko"], "RSA-generic", "vulnerable", "high"),
    ("DEP-PY-PYOPENSSL", ["pyopenssl"], "RSA-generic", "weakened", "medium"),
    ("DEP-PY-JWT", ["python-jose", "jose", "pyjwt"], "RSA-generic", "weakened", "medium"),
    ("DEP-PY-BCRYPT", ["bcrypt"], "SHA-256", "weakened", "low"),
    ("DEP-PY-RSA", ["rsa"], "RSA-generic", "vulnerable", "high"),
    ("DEP-PY-ECDSA", ["ecdsa"], "ECDSA-generic", "vulnerable", "high"),
]
NODE_LIBRARIES = [
    ("DEP-NODE-CRYPTOJS", ["crypto-js"], "RSA-generic", "vulnerable", "high"),
    ("DEP-NODE-NODEFORGE", ["node-forge"], "RSA-generic", "vulnerable", "high"),
    ("DEP-NODE-BCRYPT", ["bcrypt", "bcryptjs"], "SHA-256", "weakened", "low"),
    ("DEP-NODE-JSONWEBTOKEN", ["jsonwebtoken"], "RSA-generic", "weakened", "medium"),
    ("DEP-NODE-JOSE", ["jose"], "RSA-generic", "weakened", "medium"),
    ("DEP-NODE-NODERSA", ["node-rsa"], "RSA-generic", "vulnerable", "high"),
    ("DEP-NODE-ELLIPTIC", ["elliptic"], "ECDSA-generic", "vulnerable", "high"),
]
JAVA_LIBRARIES = [
    ("DEP-JAVA-BOUNCYCASTLE", ["org.bouncycastle"], "RSA-generic", "weakened", "medium"),
    ("DEP-JAVA-JASYPT", ["org.jasypt", "jasypt"], "RSA-generic", "vulnerable", "high"),
    ("DEP-JAVA-JWT", ["com.auth0:java-jwt", "java-jwt"], "RSA-generic", "weakened", "medium"),
    ("DEP-JAVA-NIMBUS", ["com.nimbusds:nimbus-jose-jwt", "nimbus-jose-jwt"], "RSA-generic", "weakened", "medium"),
]
GO_LIBRARIES = [
    ("DEP-GO-XCRYPTO", ["golang.org/x/crypto"], "RSA-generic", "weakened", "medium"),
    ("DEP-GO-JWTGO-DEPRECATED", ["github.com/dgrijalva/jwt-go"], "RSA-generic", "vulnerable", "high"),
    ("DEP-GO-GOLANGJWT", ["github.com/golang-jwt/jwt"], "RSA-generic", "weakened", "medium"),
]

# manifest syntax
NODE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
PACKAGE_NAME = r"^([A-Za-z0-9][-A-Za-z0-9_.]*)"
GRADLE_SCOPES = "(?:implementation|compile|api|runtimeOnly|testImplementation|compileOnly)"
MANIFEST_CONFIDENCE = 0.7
