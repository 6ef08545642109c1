"""Rules over text lines and whole documents."""

# Fixed values -------------------------------------------------------------

# (rule_id, pattern, algorithm name, family, quantum_risk, severity)
SECRETS = [
    ("SEC-PEM-RSA", "-----BEGIN RSA PRIVATE KEY-----", "RSA-PrivateKey", "RSA", "vulnerable", "critical"),
    ("SEC-PEM-DSA", "-----BEGIN DSA PRIVATE KEY-----", "DSA-PrivateKey", "DSA", "vulnerable", "critical"),
    ("SEC-PEM-ECC", "-----BEGIN EC PRIVATE KEY-----", "ECC-PrivateKey", "ECC", "vulnerable", "critical"),
    ("SEC-PEM-PKCS8", "-----BEGIN PRIVATE KEY-----", "PKCS#8-PrivateKey", "RSA", "vulnerable", "critical"),
    ("SEC-PEM-OPENSSH", "-----BEGIN OPENSSH PRIVATE KEY-----", "OpenSSH-PrivateKey", "RSA", "vulnerable", "critical"),
    ("SEC-PEM-ENCRYPTED-PKCS8", "-----BEGIN ENCRYPTED PRIVATE KEY-----", "Encrypted-PKCS#8-PrivateKey", "RSA", "vulnerable", "high"),
    ("SEC-PEM-X509-EMBEDDED", "-----BEGIN CERTIFICATE-----", "X.509-Embedded-PrivateKey", "RSA", "vulnerable", "medium"),
    ("SEC-APIKEY-AWSACCESSKEY", r"AKIA[0-9A-Z]{16}", "AWS-Access-Key-Credential", "Unknown", "unknown", "critical"),
    ("SEC-APIKEY-AZUREKEYVAULTURL", r"https://[a-zA-Z0-9-]+\.vault\.azure\.net/keys/", "Azure-Key-Vault-URL-Credential", "Unknown", "unknown", "high"),
    ("SEC-APIKEY-GCPKMSKEY", r"projects/[a-zA-Z0-9-]+/locations/[a-zA-Z0-9-]+/keyRings/[a-zA-Z0-9-]+/cryptoKeys/", "GCP-KMS-Key-Credential", "Unknown", "unknown", "high"),
    ("SEC-APIKEY-HASHICORPVAULTTOKEN", r"hvs\.[a-zA-Z0-9]{24,}", "HashiCorp-Vault-Token-Credential", "Unknown", "unknown", "critical"),
    ("SEC-WEAK-HARDCODEDSECRET", r"""(?:key|secret|password|token)\s*=\s*['"][^'"]{4,}['"]""", "Hardcoded-Secret", "Random", "unknown", "high"),
    ("SEC-WEAK-STATICIV", r"""iv\s*=\s*(?:b)?['\"]\\x00|iv\s*=\s*bytes\(\s*16\s*\)""", "Static-IV", "Random", "unknown", "high"),
    ("SEC-WEAK-WEAKSEED", r"random\.seed\(\s*\d+\s*\)|srand\(\s*\d+\s*\)|srand\(time\(", "Weak-Seed", "Random", "unknown", "high"),
]

# suffixes read by the secrets detector, and suffixes it never reads
SECRET_SUFFIXES = [
    ".py", ".java", ".js", ".ts", ".jsx", ".tsx", ".go", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".rs",
    ".swift", ".kt", ".kts", ".php", ".rb", ".scala", ".sc", ".dart", ".yaml", ".yml", ".json", ".xml",
    ".toml", ".ini", ".cfg", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".env", ".properties", ".conf",
    ".tf", ".hcl", ".dockerfile", ".docker-compose.yml",
]
SECRET_SKIPPED = [
    ".pem", ".crt", ".cer", ".der", ".p12", ".pfx", ".key", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg",
    ".bmp", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".o", ".a",
    ".pyc", ".pyo", ".class", ".jar", ".war", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".avi",
    ".mov", ".wav", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
]

# Whole-document rules; flags: i = ignore case, s = dot matches newline.
# (rule_id, flags, pattern, algorithm name, family, quantum_risk, severity)
TERRAFORM = [
    ("IAC-TF-TLS-RSA", "s", r'resource\s+"tls_private_key".*?algorithm\s*=\s*"RSA"', "RSA-TLS-Key", "RSA", "vulnerable", "high"),
    ("IAC-TF-TLS-ECDSA", "s", r'resource\s+"tls_private_key".*?algorithm\s*=\s*"ECDSA"', "ECDSA-TLS-Key", "ECDSA", "vulnerable", "high"),
    ("IAC-TF-RSA-1024", "", r"rsa_bits\s*=\s*1024", "RSA-1024", "RSA", "vulnerable", "critical"),
    ("IAC-TF-RSA-2048", "", r"rsa_bits\s*=\s*2048", "RSA-2048", "RSA", "vulnerable", "high"),
    ("IAC-TF-KMS-RSA", "", r'customer_master_key_spec\s*=\s*"RSA_\d+"', "AWS-KMS-RSA", "RSA", "vulnerable", "high"),
    ("IAC-TF-KMS-ECC", "", r'customer_master_key_spec\s*=\s*"ECC_', "AWS-KMS-ECC", "ECC", "vulnerable", "high"),
    ("IAC-TF-ALB-WEAK-TLS", "", r'ssl_policy\s*=\s*"ELBSecurityPolicy-2016-08"', "Weak-TLS-Policy", "RSA", "vulnerable", "high"),
    ("IAC-TF-CF-WEAK-TLS", "", r'minimum_protocol_version\s*=\s*"(TLSv1|TLSv1_2016|SSLv3)"', "Weak-CloudFront-TLS", "RSA", "vulnerable", "high"),
    ("IAC-TF-AKV-RSA", "", r'key_type\s*=\s*"RSA"', "Azure-KV-RSA", "RSA", "vulnerable", "high"),
    ("IAC-TF-AKV-EC", "", r'key_type\s*=\s*"EC"', "Azure-KV-EC", "ECC", "vulnerable", "high"),
    ("IAC-TF-GCP-KMS-RSA", "", r'algorithm\s*=\s*"RSA_', "GCP-KMS-RSA", "RSA", "vulnerable", "high"),
    ("IAC-TF-GCP-KMS-EC", "", r'algorithm\s*=\s*"EC_SIGN_', "GCP-KMS-EC", "ECC", "vulnerable", "high"),
]
CLOUDFORMATION = [
    ("IAC-CFN-KMS-RSA", "i", r"KeySpec\s*:\s*RSA_\d+", "AWS-KMS-RSA", "RSA", "vulnerable", "high"),
    ("IAC-CFN-KMS-ECC", "i", r"KeySpec\s*:\s*ECC_", "AWS-KMS-ECC", "ECC", "vulnerable", "high"),
    ("IAC-CFN-ACM-CERT", "", r"AWS::CertificateManager::Certificate", "ACM-Certificate", "RSA", "weakened", "medium"),
    ("IAC-CFN-ALB-WEAK-TLS", "", r"SslPolicy\s*:\s*ELBSecurityPolicy-2016-08", "Weak-TLS-Policy", "RSA", "vulnerable", "high"),
    ("IAC-CFN-CF-WEAK-TLS", "i", r"MinimumProtocolVersion\s*:\s*(TLSv1|TLSv1_2016|SSLv3)", "Weak-CloudFront-TLS", "RSA", "vulnerable", "high"),
    ("IAC-CFN-KEY-RSA", "i", r"KeyAlgorithm\s*:\s*RSA_\d+", "CFN-RSA-Key", "RSA", "vulnerable", "high"),
    ("IAC-CFN-KEY-ECC", "i", r"KeyAlgorithm\s*:\s*EC_", "CFN-ECC-Key", "ECC", "vulnerable", "high"),
]
ANSIBLE = [
    ("IAC-ANS-PRIVKEY-RSA", "is", r"community\.crypto\.openssl_privatekey.*?type\s*:\s*RSA", "Ansible-RSA-PrivKey", "RSA", "vulnerable", "high"),
    ("IAC-ANS-PRIVKEY-DSA", "is", r"community\.crypto\.openssl_privatekey.*?type\s*:\s*DSA", "Ansible-DSA-PrivKey", "DSA", "vulnerable", "critical"),
    ("IAC-ANS-PRIVKEY-ECC", "is", r"community\.crypto\.openssl_privatekey.*?type\s*:\s*ECC", "Ansible-ECC-PrivKey", "ECC", "vulnerable", "high"),
    ("IAC-ANS-PRIVKEY", "i", r"openssl_privatekey\s*:", "Ansible-PrivKey", "RSA", "weakened", "medium"),
    ("IAC-ANS-X509", "i", r"community\.crypto\.x509_certificate", "Ansible-X509-Cert", "RSA", "weakened", "medium"),
    ("IAC-ANS-CSR-1024", "", r"privatekey_size\s*:\s*1024", "Ansible-RSA-1024", "RSA", "vulnerable", "critical"),
    ("IAC-ANS-CSR-2048", "", r"privatekey_size\s*:\s*2048", "Ansible-RSA-2048", "RSA", "vulnerable", "high"),
    ("IAC-ANS-NO-CERT-VALID", "i", r"validate_certs\s*:\s*(false|no)\b", "Ansible-No-CertValidation", "RSA", "weakened", "high"),
]
DOCKERFILE = [
    ("CTR-DOCKER-GENRSA", "i", r"RUN\s+.*openssl\s+genrsa", "Docker-OpenSSL-GenRSA", "RSA", "vulnerable", "high"),
    ("CTR-DOCKER-GENRSA-1024", "i", r"RUN\s+.*openssl\s+genrsa\s+.*\b1024\b", "Docker-RSA-1024", "RSA", "vulnerable", "critical"),
    ("CTR-DOCKER-ECPARAM", "i", r"RUN\s+.*openssl\s+ecparam", "Docker-OpenSSL-ECParam", "ECC", "vulnerable", "high"),
    ("CTR-DOCKER-REQ-RSA", "i", r"RUN\s+.*openssl\s+req\s+.*-newkey\s+rsa:", "Docker-OpenSSL-Req-RSA", "RSA", "vulnerable", "high"),
    ("CTR-DOCKER-REQ", "i", r"RUN\s+.*openssl\s+req\b", "Docker-OpenSSL-Req", "RSA", "weakened", "medium"),
    ("CTR-DOCKER-EMBED-CERTS", "i", r"COPY\s+.*\*?\.(pem|key|crt|cert)\b", "Docker-Embedded-Certs", "RSA", "weakened", "medium"),
    ("CTR-DOCKER-PIP-PYCRYPTODOME", "i", r"RUN\s+.*pip\s+install\s+.*pycryptodome", "Docker-PyCryptodome", "RSA", "weakened", "medium"),
    ("CTR-DOCKER-PIP-CRYPTOGRAPHY", "i", r"RUN\s+.*pip\s+install\s+.*cryptography\b", "Docker-Cryptography", "RSA", "weakened", "low"),
    ("CTR-DOCKER-NPM-CRYPTOJS", "i", r"RUN\s+.*npm\s+install\s+.*crypto-js", "Docker-CryptoJS", "RSA", "weakened", "medium"),
    ("CTR-DOCKER-NPM-NODEFORGE", "i", r"RUN\s+.*npm\s+install\s+.*node-forge", "Docker-NodeForge", "RSA", "weakened", "medium"),
]
KUBERNETES = [
    ("CTR-K8S-TLS-SECRET", "", r"type\s*:\s*kubernetes\.io/tls", "K8s-TLS-Secret", "RSA", "weakened", "medium"),
    ("CTR-K8S-INGRESS-TLS", "s", r"kind\s*:\s*Ingress.*?tls\s*:", "K8s-Ingress-TLS", "RSA", "weakened", "medium"),
    ("CTR-K8S-CERTMGR-RSA", "is", r"kind\s*:\s*Certificate.*?algorithm\s*:\s*RSA", "K8s-CertManager-RSA", "RSA", "vulnerable", "high"),
    ("CTR-K8S-CERTMGR-ECDSA", "is", r"kind\s*:\s*Certificate.*?algorithm\s*:\s*ECDSA", "K8s-CertManager-ECDSA", "ECDSA", "vulnerable", "high"),
    ("CTR-K8S-CERTMGR-1024", "s", r"kind\s*:\s*Certificate.*?size\s*:\s*1024", "K8s-CertManager-1024", "RSA", "vulnerable", "critical"),
    ("CTR-K8S-ISTIO-MTLS-WEAK", "is", r"kind\s*:\s*PeerAuthentication.*?mode\s*:\s*(PERMISSIVE|DISABLE)", "Istio-Weak-mTLS", "RSA", "weakened", "high"),
    ("CTR-K8S-ISTIO-TLS-SIMPLE", "is", r"kind\s*:\s*DestinationRule.*?mode\s*:\s*SIMPLE", "Istio-Simple-TLS", "RSA", "weakened", "medium"),
    ("CTR-K8S-CERTMGR", "i", r"kind\s*:\s*Certificate\s*\n", "K8s-CertManager", "RSA", "weakened", "low"),
]

# words that decide which document table applies
CLOUDFORMATION_WORDS = ["AWSTemplateFormatVersion", "AWS::"]
ANSIBLE_WORDS = ["hosts:", "tasks:", "- name:", "ansible"]
KUBERNETES_WORDS = ["kind:", "apiVersion:", "kubernetes"]
IAC_SUFFIXES = [".tf", ".yaml", ".yml", ".json"]
CONTAINER_SUFFIXES = [".yaml", ".yml", ".dockerfile"]

# confidence adjustment
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "mock", "mocks", "__test__", "__tests__", "_test", "_tests"]
SUPPRESSIONS = ["# noqa", "# nosec", "pragma: no cover"]
SENSITIVE_WORDS = ["password", "secret", "private_key", "credential", "credentials", "api_key", "apikey"]
DEMO_WORDS = ["test", "example", "sample", "demo", "mock"]
COMMENT_LINE = r"^\s*(#|//|/\*|\*)"
