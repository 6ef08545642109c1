"""Source-code usage rules, one table per language.

Row: (rule_id, algorithm_key, pattern[, severity_override[, risk_override]]).
An override of None keeps the value derived from the algorithm. Message and
recommendation texts are composed from the algorithm (see sources/rules.py).
"""

# Fixed values -------------------------------------------------------------

PYTHON = [
    ("PY-RSA-GENERATE", "RSA-generic", r"rsa\.generate_private_key|RSA\.generate|generate_private_key\(.*rsa"),
    ("PY-RSA-IMPORT", "RSA-generic", r"from\s+cryptography\.hazmat\.primitives\.asymmetric\s+import\s+rsa|from\s+Crypto\.PublicKey\s+import\s+RSA|from\s+Cryptodome\.PublicKey\s+import\s+RSA"),
    ("PY-RSA-KEYSIZE-1024", "RSA-1024", r"key_size\s*=\s*1024|generate\(\s*1024\s*[,)]"),
    ("PY-RSA-KEYSIZE-2048", "RSA-2048", r"key_size\s*=\s*2048|generate\(\s*2048\s*[,)]"),
    ("PY-ECC-GENERATE", "ECC-generic", r"ec\.generate_private_key|ECC\.generate|generate_private_key\(.*ec\."),
    ("PY-ECC-IMPORT", "ECC-generic", r"from\s+cryptography\.hazmat\.primitives\.asymmetric\s+import\s+ec|from\s+Crypto\.PublicKey\s+import\s+ECC"),
    ("PY-ECDSA-IMPORT", "ECDSA-generic", r"import\s+ecdsa|from\s+ecdsa\s+import"),
    ("PY-DSA-IMPORT", "DSA-generic", r"from\s+cryptography\.hazmat\.primitives\.asymmetric\s+import\s+dsa|from\s+Crypto\.PublicKey\s+import\s+DSA"),
    ("PY-DH-IMPORT", "DH-generic", r"from\s+cryptography\.hazmat\.primitives\.asymmetric\s+import\s+dh|from\s+Crypto\.PublicKey\s+import\s+DH"),
    ("PY-DES-USE", "DES", r"DES\.new|algorithms\.TripleDES|algorithms\.DES\b|DES3\.new|Blowfish\.new"),
    ("PY-DES-IMPORT", "DES", r"from\s+Crypto\.Cipher\s+import\s+DES|from\s+Cryptodome\.Cipher\s+import\s+DES"),
    ("PY-3DES-IMPORT", "3DES", r"from\s+Crypto\.Cipher\s+import\s+DES3|from\s+Cryptodome\.Cipher\s+import\s+DES3"),
    ("PY-MD5-USE", "MD5", r"hashlib\.md5|MD5\.new|algorithms\.MD5|md5\(\)"),
    ("PY-SHA1-USE", "SHA-1", r"hashlib\.sha1|SHA1\.new|SHA\.new|algorithms\.SHA1|hashes\.SHA1"),
    ("PY-RC4-USE", "RC4", r"ARC4\.new|algorithms\.ARC4|RC4"),
    ("PY-BLOWFISH-USE", "Blowfish", r"Blowfish\.new|algorithms\.Blowfish"),
    ("PY-ECB-MODE", "AES-128", r"modes\.ECB|MODE_ECB|AES\.new\([^)]*,\s*AES\.MODE_ECB"),
    ("PY-WEAK-RANDOM", "RSA-generic", r"random\.random|random\.randint|random\.choice|random\.seed", "medium", "unknown"),
]

JAVA = [
    ("JAVA-RSA-GENERATE", "RSA-generic", r'KeyPairGenerator\.getInstance\(\s*"RSA"'),
    ("JAVA-RSA-KEYSIZE-1024", "RSA-1024", r"\.initialize\(\s*1024"),
    ("JAVA-RSA-KEYSIZE-2048", "RSA-2048", r"\.initialize\(\s*2048"),
    ("JAVA-RSA-KEYSIZE-4096", "RSA-4096", r"\.initialize\(\s*4096"),
    ("JAVA-DSA-GENERATE", "DSA-generic", r'KeyPairGenerator\.getInstance\(\s*"DSA"'),
    ("JAVA-EC-GENERATE", "ECC-generic", r'KeyPairGenerator\.getInstance\(\s*"EC"|KeyPairGenerator\.getInstance\(\s*"ECDSA"'),
    ("JAVA-DH-GENERATE", "DH-generic", r'KeyPairGenerator\.getInstance\(\s*"DH"|KeyPairGenerator\.getInstance\(\s*"DiffieHellman"'),
    ("JAVA-DES-USE", "DES", r'Cipher\.getInstance\(\s*"DES[/"]'),
    ("JAVA-3DES-USE", "3DES", r'Cipher\.getInstance\(\s*"DESede|Cipher\.getInstance\(\s*"TripleDES'),
    ("JAVA-BLOWFISH-USE", "Blowfish", r'Cipher\.getInstance\(\s*"Blowfish'),
    ("JAVA-RC4-USE", "RC4", r'Cipher\.getInstance\(\s*"RC4"|Cipher\.getInstance\(\s*"ARCFOUR"'),
    ("JAVA-MD5-USE", "MD5", r'MessageDigest\.getInstance\(\s*"MD5"'),
    ("JAVA-SHA1-USE", "SHA-1", r'MessageDigest\.getInstance\(\s*"SHA-?1"'),
    ("JAVA-ECB-MODE", "AES-128", r'Cipher\.getInstance\(\s*"AES/ECB|Cipher\.getInstance\(\s*"DESede/ECB|/ECB/PKCS5Padding'),
    ("JAVA-SIGNATURE-RSA", "RSA-generic", r'Signature\.getInstance\(\s*"SHA\d*withRSA"|Signature\.getInstance\(\s*"MD5withRSA"'),
    ("JAVA-SIGNATURE-ECDSA", "ECDSA-generic", r'Signature\.getInstance\(\s*"SHA\d*withECDSA"'),
    ("JAVA-SSL-CONTEXT", "RSA-generic", r'SSLContext\.getInstance\(\s*"TLSv1\.?[012]?"|SSLContext\.getInstance\(\s*"SSL"', "medium"),
    ("JAVA-BC-RSA", "RSA-generic", r"org\.bouncycastle\.crypto\.generators\.RSAKeyPairGenerator|RSAKeyGenerationParameters"),
    ("JAVA-BC-EC", "ECC-generic", r"org\.bouncycastle\.crypto\.generators\.ECKeyPairGenerator|ECKeyGenerationParameters"),
    ("JAVA-WEAK-RANDOM", "RSA-generic", r"new\s+Random\(|java\.util\.Random", "medium", "unknown"),
]

JAVASCRIPT = [
    ("JS-MD5-USE", "MD5", r"""crypto\.createHash\(\s*['"]md5['"]|createHash\(\s*['"]md5['"]"""),
    ("JS-SHA1-USE", "SHA-1", r"""crypto\.createHash\(\s*['"]sha1['"]|createHash\(\s*['"]sha1['"]"""),
    ("JS-DES-USE", "DES", r"""createCipher(?:iv)?\(\s*['"]des['"]|createCipher(?:iv)?\(\s*['"]des-ede"""),
    ("JS-3DES-USE", "3DES", r"""createCipher(?:iv)?\(\s*['"]des-ede3|createCipher(?:iv)?\(\s*['"]des3"""),
    ("JS-RC4-USE", "RC4", r"""createCipher(?:iv)?\(\s*['"]rc4['"]"""),
    ("JS-BLOWFISH-USE", "Blowfish", r"""createCipher(?:iv)?\(\s*['"]bf['"]|createCipher(?:iv)?\(\s*['"]blowfish['"]|createCipher(?:iv)?\(\s*['"]bf-cbc['"]"""),
    ("JS-RSA-GENERATE", "RSA-generic", r"""generateKeyPair(?:Sync)?\(\s*['"]rsa['"]"""),
    ("JS-DSA-GENERATE", "DSA-generic", r"""generateKeyPair(?:Sync)?\(\s*['"]dsa['"]"""),
    ("JS-EC-GENERATE", "ECC-generic", r"""generateKeyPair(?:Sync)?\(\s*['"]ec['"]"""),
    ("JS-DH-USE", "DH-generic", r"crypto\.createDiffieHellman|crypto\.createDiffieHellmanGroup|crypto\.createECDH"),
    ("JS-CRYPTOJS-MD5", "MD5", r"CryptoJS\.MD5|CryptoJS\.HmacMD5"),
    ("JS-CRYPTOJS-SHA1", "SHA-1", r"CryptoJS\.SHA1|CryptoJS\.HmacSHA1"),
    ("JS-CRYPTOJS-DES", "DES", r"CryptoJS\.DES\.encrypt|CryptoJS\.DES\.decrypt|CryptoJS\.TripleDES"),
    ("JS-CRYPTOJS-ECB", "AES-128", r"CryptoJS\.mode\.ECB|mode:\s*CryptoJS\.mode\.ECB"),
    ("JS-FORGE-RSA", "RSA-generic", r"forge\.pki\.rsa\.generateKeyPair|forge\.rsa\.generateKeyPair|forge\.pki\.rsa\.setPublicKey"),
    ("JS-JWT-RSA", "RSA-generic", r"""algorithm:\s*['"]RS(256|384|512)['"]|alg:\s*['"]RS(256|384|512)['"]"""),
    ("JS-JWT-EC", "ECDSA-generic", r"""algorithm:\s*['"]ES(256|384|512)['"]|alg:\s*['"]ES(256|384|512)['"]"""),
    ("JS-WEBCRYPTO-RSA", "RSA-generic", r"subtle\.generateKey\([^)]*RSASSA-PKCS1|subtle\.generateKey\([^)]*RSA-PSS|subtle\.generateKey\([^)]*RSA-OAEP"),
    ("JS-WEBCRYPTO-EC", "ECDSA-generic", r"subtle\.generateKey\([^)]*ECDSA|subtle\.generateKey\([^)]*ECDH"),
    ("JS-WEAK-RANDOM", "RSA-generic", r"Math\.random\(\)", "medium", "unknown"),
]

TYPESCRIPT = [
    ("TS-RSA-GENERATE", "RSA-generic", r"""generateKeyPair\(['"]rsa|generateKeyPairSync\(['"]rsa|crypto\.subtle\.generateKey\(\{.*RSA"""),
    ("TS-RSA-IMPORT", "RSA-generic", r"""import.*crypto.*RSA|require\(['"]crypto['"]\).*rsa"""),
    ("TS-RSA-KEYSIZE-1024", "RSA-1024", r"modulusLength:\s*1024"),
    ("TS-RSA-KEYSIZE-2048", "RSA-2048", r"modulusLength:\s*2048"),
    ("TS-ECC-GENERATE", "ECC-generic", r"""generateKeyPair\(['"]ec|crypto\.subtle\.generateKey\(\{.*ECDSA|crypto\.subtle\.generateKey\(\{.*ECDH"""),
    ("TS-ECDSA-USE", "ECDSA-generic", r"createSign\(.*ecdsa|ECDSA|sign\(\{.*algorithm.*ECDSA"),
    ("TS-DH-GENERATE", "DH-generic", r"createDiffieHellman|createDiffieHellmanGroup|createECDH"),
    ("TS-DES-USE", "DES", r"""createCipheriv\(['"]des|createCipher\(['"]des|DES|des-ede3"""),
    ("TS-3DES-USE", "3DES", r"""createCipheriv\(['"]des-ede3|des-ede3-cbc"""),
    ("TS-MD5-USE", "MD5", r"""createHash\(['"]md5|CryptoJS\.MD5|md5\("""),
    ("TS-SHA1-USE", "SHA-1", r"""createHash\(['"]sha1|CryptoJS\.SHA1"""),
    ("TS-RC4-USE", "RC4", r"""createCipheriv\(['"]rc4|CryptoJS\.RC4"""),
    ("TS-BLOWFISH-USE", "Blowfish", r"""createCipheriv\(['"]bf|CryptoJS\.Blowfish"""),
    ("TS-ECB-MODE", "AES-128", r"CryptoJS\.mode\.ECB|ECB|createCipheriv\(.*ecb"),
    ("TS-WEAK-RANDOM", "RSA-generic", r"Math\.random\(\)|Math\.floor\(Math\.random", "medium", "unknown"),
    ("TS-WEBCRYPTO-RSA", "RSA-generic", r"""crypto\.subtle\.generateKey\(\{.*name:\s*['"]RSA"""),
    ("TS-WEBCRYPTO-ECDSA", "ECDSA-generic", r"""crypto\.subtle\.generateKey\(\{.*name:\s*['"]ECDSA"""),
    ("TS-WEBCRYPTO-ECDH", "ECDH-generic", r"""crypto\.subtle\.generateKey\(\{.*name:\s*['"]ECDH"""),
    ("TS-JOSE-RSA", "RSA-generic", r"jose.*RS256|jose.*RS384|jose.*RS512"),
    ("TS-NODE-RSA", "RSA-generic", r"""require\(['"]node-rsa|import.*node-rsa"""),
    ("TS-BCRYPT", "RSA-generic", r"""require\(['"]bcrypt|import.*bcrypt"""),
    ("TS-AES128", "AES-128", r"createCipheriv\(.*aes-128|aes-128"),
]

GOLANG = [
    ("GO-RSA-IMPORT", "RSA-generic", r'"crypto/rsa"'),
    ("GO-RSA-GENERATE", "RSA-generic", r"rsa\.GenerateKey\("),
    ("GO-RSA-KEYSIZE-1024", "RSA-1024", r"rsa\.GenerateKey\([^,]+,\s*1024\)"),
    ("GO-RSA-KEYSIZE-2048", "RSA-2048", r"rsa\.GenerateKey\([^,]+,\s*2048\)"),
    ("GO-DSA-IMPORT", "DSA-generic", r'"crypto/dsa"'),
    ("GO-DSA-GENERATE", "DSA-generic", r"dsa\.GenerateParameters|dsa\.GenerateKey"),
    ("GO-ECDSA-IMPORT", "ECDSA-generic", r'"crypto/ecdsa"'),
    ("GO-ECDSA-GENERATE", "ECDSA-generic", r"ecdsa\.GenerateKey\("),
    ("GO-ELLIPTIC-IMPORT", "ECC-generic", r'"crypto/elliptic"'),
    ("GO-DES-IMPORT", "DES", r'"crypto/des"'),
    ("GO-DES-USE", "DES", r"des\.NewCipher|des\.NewTripleDESCipher"),
    ("GO-RC4-IMPORT", "RC4", r'"crypto/rc4"'),
    ("GO-MD5-IMPORT", "MD5", r'"crypto/md5"'),
    ("GO-MD5-USE", "MD5", r"md5\.New\(|md5\.Sum\("),
    ("GO-SHA1-IMPORT", "SHA-1", r'"crypto/sha1"'),
    ("GO-SHA1-USE", "SHA-1", r"sha1\.New\(|sha1\.Sum\("),
    ("GO-XCRYPTO-BLOWFISH", "Blowfish", r'"golang\.org/x/crypto/blowfish"|blowfish\.NewCipher'),
    ("GO-XCRYPTO-CAST5", "Blowfish", r'"golang\.org/x/crypto/cast5"|cast5\.NewCipher', "medium"),
    ("GO-WEAK-RANDOM", "RSA-generic", r'"math/rand"|math/rand"|rand\.Intn|rand\.Int\(|rand\.Read\(', "medium", "unknown"),
]

CPP = [
    ("CPP-RSA-GENERATE", "RSA-generic", r"RSA_generate_key|RSA_generate_key_ex"),
    ("CPP-EVP-RSA", "RSA-generic", r"EVP_PKEY_RSA|EVP_PKEY_CTX_set_rsa_keygen_bits"),
    ("CPP-EVP-DSA", "DSA-generic", r"EVP_PKEY_DSA|DSA_generate_parameters|DSA_generate_key"),
    ("CPP-EVP-EC", "ECC-generic", r"EVP_PKEY_EC|EC_KEY_generate_key|EC_KEY_new_by_curve_name"),
    ("CPP-DH-USE", "DH-generic", r"DH_generate_parameters|DH_generate_key|EVP_PKEY_DH"),
    ("CPP-DES-EVP", "DES", r"EVP_des_cbc|EVP_des_ecb|EVP_des_cfb|EVP_des_ofb|EVP_des_ede3"),
    ("CPP-DES-DIRECT", "DES", r"DES_set_key|DES_ecb_encrypt|DES_cbc_encrypt|DES_ncbc_encrypt"),
    ("CPP-MD5-EVP", "MD5", r"EVP_md5\(|MD5_Init|MD5_Update|MD5_Final|MD5\("),
    ("CPP-SHA1-EVP", "SHA-1", r"EVP_sha1\(|SHA1_Init|SHA1_Update|SHA1_Final|SHA1\("),
    ("CPP-RC4-USE", "RC4", r"EVP_rc4\(|RC4_set_key|RC4\("),
    ("CPP-MBED-MD5", "MD5", r"mbedtls_md5_init|mbedtls_md5_starts|mbedtls_md5_update|mbedtls_md5_finish|mbedtls_md5\("),
    ("CPP-MBED-SHA1", "SHA-1", r"mbedtls_sha1_init|mbedtls_sha1_starts|mbedtls_sha1_update|mbedtls_sha1_finish"),
    ("CPP-MBED-DES", "DES", r"mbedtls_des_init|mbedtls_des_setkey|mbedtls_des3_init|mbedtls_des_crypt"),
    ("CPP-MBED-RSA", "RSA-generic", r"mbedtls_rsa_init|mbedtls_rsa_gen_key|mbedtls_rsa_pkcs1_encrypt"),
    ("CPP-WINCRYPT-MD5", "MD5", r"CALG_MD5|CryptCreateHash\([^)]*CALG_MD5"),
    ("CPP-WINCRYPT-SHA1", "SHA-1", r"CALG_SHA\b|CALG_SHA1|CryptCreateHash\([^)]*CALG_SHA\b"),
    ("CPP-WINCRYPT-DES", "DES", r"CALG_DES|CALG_3DES|CryptCreateHash\([^)]*CALG_DES"),
    ("CPP-WINCRYPT-RC4", "RC4", r"CALG_RC4"),
    ("CPP-WEAK-RANDOM", "RSA-generic", r"\brand\(\)|\bsrand\(|std::rand\(\)|std::default_random_engine", "medium", "unknown"),
]

CSHARP = [
    ("CS-RSA-PROVIDER", "RSA-generic", r"new\s+RSACryptoServiceProvider|RSACryptoServiceProvider\("),
    ("CS-RSA-CREATE", "RSA-generic", r"RSA\.Create\(\)"),
    ("CS-RSA-KEYSIZE-1024", "RSA-1024", r"RSA\.Create\(\s*1024\s*\)|RSACryptoServiceProvider\(\s*1024\s*\)"),
    ("CS-RSA-KEYSIZE-2048", "RSA-2048", r"RSA\.Create\(\s*2048\s*\)|RSACryptoServiceProvider\(\s*2048\s*\)"),
    ("CS-DSA-PROVIDER", "DSA-generic", r"new\s+DSACryptoServiceProvider|DSACryptoServiceProvider\(|DSA\.Create\("),
    ("CS-ECDSA-USE", "ECDSA-generic", r"ECDsa\.Create|ECDsaCng\(|new\s+ECDsaCng"),
    ("CS-ECDH-USE", "ECDH-generic", r"ECDiffieHellman\.Create|ECDiffieHellmanCng\(|new\s+ECDiffieHellmanCng"),
    ("CS-MD5-USE", "MD5", r"MD5\.Create\(|MD5CryptoServiceProvider\(|new\s+MD5CryptoServiceProvider"),
    ("CS-SHA1-USE", "SHA-1", r"SHA1\.Create\(|SHA1CryptoServiceProvider\(|SHA1Managed\(|new\s+SHA1CryptoServiceProvider|new\s+SHA1Managed"),
    ("CS-DES-USE", "DES", r"DESCryptoServiceProvider\(|new\s+DESCryptoServiceProvider|DES\.Create\("),
    ("CS-3DES-USE", "3DES", r"TripleDESCryptoServiceProvider\(|new\s+TripleDESCryptoServiceProvider|TripleDES\.Create\("),
    ("CS-ECB-MODE", "AES-128", r"CipherMode\.ECB|Mode\s*=\s*CipherMode\.ECB"),
    ("CS-RIJNDAEL-USE", "AES-128", r"RijndaelManaged\(|new\s+RijndaelManaged", "medium"),
    ("CS-RC2-USE", "RC4", r"RC2CryptoServiceProvider\(|new\s+RC2CryptoServiceProvider"),
    ("CS-CRYPTO-NAMESPACE", "RSA-generic", r"using\s+System\.Security\.Cryptography", "low", "unknown"),
    ("CS-RSAPKCS1-SIGN", "RSA-generic", r"RSAPKCS1SignatureFormatter|RSAPKCS1SignatureDeformatter|SignData\(|VerifyData\("),
    ("CS-X509-RSA", "RSA-generic", r"X509Certificate2\(|new\s+X509Certificate2|X509Store\(", "low", "unknown"),
    ("CS-WEAK-RANDOM", "RSA-generic", r"new\s+Random\(|Random\(\)|System\.Random", "medium", "unknown"),
]

RUST = [
    ("RS-RSA-GENERATE", "RSA-generic", r"RsaPrivateKey::new|rsa::RsaPrivateKey|RSA_generate_key"),
    ("RS-RSA-IMPORT", "RSA-generic", r"use\s+rsa::|extern\s+crate\s+rsa"),
    ("RS-RSA-KEYSIZE-1024", "RSA-1024", r"bits:\s*1024|key_size.*1024"),
    ("RS-RSA-KEYSIZE-2048", "RSA-2048", r"bits:\s*2048|key_size.*2048"),
    ("RS-ECC-GENERATE", "ECC-generic", r"EphemeralSecret::random|SecretKey::random|p256::SecretKey|p384::SecretKey"),
    ("RS-ECC-IMPORT", "ECC-generic", r"use\s+p256::|use\s+p384::|use\s+elliptic_curve::"),
    ("RS-ECDSA-IMPORT", "ECDSA-generic", r"use\s+ecdsa::|ecdsa::SigningKey"),
    ("RS-DSA-USE", "DSA-generic", r"dsa::|DSA"),
    ("RS-DH-USE", "DH-generic", r"diffie_hellman|DiffieHellman|dh::"),
    ("RS-DES-USE", "DES", r"des::|Des::new|DesEde3|TripleDes"),
    ("RS-3DES-USE", "3DES", r"des::TdesEde3|DesEde3Cbc"),
    ("RS-MD5-USE", "MD5", r"md5::|Md5::new|use\s+md\-5|md5::compute"),
    ("RS-SHA1-USE", "SHA-1", r"sha1::|Sha1::new|use\s+sha\-1|sha1::Sha1"),
    ("RS-RC4-USE", "RC4", r"rc4::|Rc4::new"),
    ("RS-BLOWFISH-USE", "Blowfish", r"blowfish::|Blowfish::new"),
    ("RS-ECB-MODE", "AES-128", r"Ecb::|ecb::|BlockMode.*ecb"),
    ("RS-WEAK-RANDOM", "RSA-generic", r"rand::thread_rng|thread_rng\(\)|StdRng::from_seed", "medium", "unknown"),
    ("RS-RING-RSA", "RSA-generic", r"ring::signature::RSA|ring::rsa"),
    ("RS-RING-ECDSA", "ECDSA-generic", r"ring::signature::ECDSA"),
    ("RS-OPENSSL-RSA", "RSA-generic", r"openssl::rsa::|openssl::pkey::PKey"),
    ("RS-OPENSSL-DES", "DES", r"openssl::symm::Cipher::des"),
    ("RS-OPENSSL-MD5", "MD5", r"openssl::hash::MessageDigest::md5"),
    ("RS-OPENSSL-SHA1", "SHA-1", r"openssl::hash::MessageDigest::sha1"),
    ("RS-RUSTLS-WEAK", "RSA-generic", r"rustls::cipher_suite.*TLS.*RSA|CipherSuite.*RSA"),
]

SWIFT = [
    ("SW-RSA-GENERATE", "RSA-generic", r"SecKeyGeneratePair|SecKeyCreateRandomKey.*kSecAttrKeyTypeRSA"),
    ("SW-RSA-IMPORT", "RSA-generic", r"import\s+Security|kSecAttrKeyTypeRSA"),
    ("SW-RSA-KEYSIZE-1024", "RSA-1024", r"kSecAttrKeySizeInBits.*1024"),
    ("SW-RSA-KEYSIZE-2048", "RSA-2048", r"kSecAttrKeySizeInBits.*2048"),
    ("SW-ECC-GENERATE", "ECC-generic", r"P256\.Signing\.PrivateKey|P384\.Signing\.PrivateKey|P256\.KeyAgreement|SecKeyCreateRandomKey.*kSecAttrKeyTypeEC"),
    ("SW-ECC-IMPORT", "ECC-generic", r"import\s+CryptoKit|CryptoKit\.P256|CryptoKit\.P384"),
    ("SW-ECDSA-USE", "ECDSA-generic", r"ECDSASignature|ECDSA\.Signing"),
    ("SW-ECDH-USE", "ECDH-generic", r"ECDH\.PrivateKey|KeyAgreement\.PrivateKey"),
    ("SW-DSA-USE", "DSA-generic", r"kSecAttrKeyTypeDSA|DSA"),
    ("SW-DH-USE", "DH-generic", r"kSecAttrKeyTypeDH|DiffieHellman"),
    ("SW-DES-USE", "DES", r"CCAlgorithm.*kCCAlgorithmDES|kCCAlgorithm3DES|CCCrypt.*DES"),
    ("SW-3DES-USE", "3DES", r"kCCAlgorithm3DES|CCAlgorithm.*3DES|TripleDES"),
    ("SW-MD5-USE", "MD5", r"CC_MD5|Insecure\.MD5|CommonCrypto.*MD5"),
    ("SW-SHA1-USE", "SHA-1", r"CC_SHA1|Insecure\.SHA1|CommonCrypto.*SHA1"),
    ("SW-RC4-USE", "RC4", r"kCCAlgorithmRC4|CCAlgorithm.*RC4"),
    ("SW-BLOWFISH-USE", "Blowfish", r"kCCAlgorithmBlowfish|CCAlgorithm.*Blowfish"),
    ("SW-ECB-MODE", "AES-128", r"kCCOptionECBMode|kCCModeCBC.*ECB"),
    ("SW-WEAK-RANDOM", "RSA-generic", r"arc4random\(\)|drand48|srand48", "medium", "unknown"),
    ("SW-COMMONCRYPTO-IMPORT", "RSA-generic", r"import\s+CommonCrypto"),
    ("SW-KEYCHAIN-RSA", "RSA-generic", r"SecItemAdd.*kSecAttrKeyTypeRSA"),
    ("SW-AES128-USE", "AES-128", r"kCCKeySizeAES128|AES\.GCM.*128"),
    ("SW-SSL-WEAK", "RSA-generic", r"SSLSetProtocolVersionMin.*kTLSProtocol1|kSSLProtocol3"),
]

KOTLIN = [
    ("KT-RSA-GENERATE", "RSA-generic", r'KeyPairGenerator\.getInstance\("RSA"\)|RSAKeyGenParameterSpec'),
    ("KT-RSA-IMPORT", "RSA-generic", r"import\s+java\.security\..*RSA|javax\.crypto.*RSA"),
    ("KT-RSA-KEYSIZE-1024", "RSA-1024", r"RSAKeyGenParameterSpec\(1024|initialize\(1024\)"),
    ("KT-RSA-KEYSIZE-2048", "RSA-2048", r"RSAKeyGenParameterSpec\(2048|initialize\(2048\)"),
    ("KT-ECC-GENERATE", "ECC-generic", r'KeyPairGenerator\.getInstance\("EC"\)|ECGenParameterSpec'),
    ("KT-ECDSA-USE", "ECDSA-generic", r'Signature\.getInstance\(".*ECDSA|ECDSASign'),
    ("KT-DSA-GENERATE", "DSA-generic", r'KeyPairGenerator\.getInstance\("DSA"\)'),
    ("KT-DH-GENERATE", "DH-generic", r'KeyPairGenerator\.getInstance\("DH"\)|DHParameterSpec'),
    ("KT-DES-USE", "DES", r'Cipher\.getInstance\("DES|DESKeySpec|DESedeKeySpec'),
    ("KT-3DES-USE", "3DES", r'Cipher\.getInstance\("DESede|DESedeKeySpec'),
    ("KT-MD5-USE", "MD5", r'MessageDigest\.getInstance\("MD5"\)|DigestUtils\.md5'),
    ("KT-SHA1-USE", "SHA-1", r'MessageDigest\.getInstance\("SHA-1"\)|DigestUtils\.sha1'),
    ("KT-RC4-USE", "RC4", r'Cipher\.getInstance\("RC4"\)|Cipher\.getInstance\("ARCFOUR"\)'),
    ("KT-BLOWFISH-USE", "Blowfish", r'Cipher\.getInstance\("Blowfish"\)'),
    ("KT-ECB-MODE", "AES-128", r'Cipher\.getInstance\("[^"]*ECB|/ECB/'),
    ("KT-WEAK-RANDOM", "RSA-generic", r"java\.util\.Random\(\)|kotlin\.random\.Random(?!\.Default\.nextBytes)", "medium", "unknown"),
    ("KT-BOUNCY-RSA", "RSA-generic", r"BouncyCastle.*RSA|BCRSAPrivateKey"),
    ("KT-BOUNCY-DES", "DES", r"BouncyCastle.*DES|DESedeEngine"),
    ("KT-BOUNCY-MD5", "MD5", r"BouncyCastle.*MD5|MD5Digest"),
    ("KT-AES128-USE", "AES-128", r"AES.*128|SecretKeySpec.*16\s*\)"),
    ("KT-SSL-WEAK", "RSA-generic", r'SSLContext\.getInstance\("TLS"|SSLContext\.getInstance\("SSL"\)', "medium"),
    ("KT-INSECURE-TRUST", "RSA-generic", r"X509TrustManager.*checkServerTrusted.*\{\s*\}|TrustAllCerts", "high"),
]

PHP = [
    ("PHP-RSA-GENERATE", "RSA-generic", r"openssl_pkey_new.*RSA|OPENSSL_KEYTYPE_RSA"),
    ("PHP-RSA-IMPORT", "RSA-generic", r"openssl_pkey_get_public|openssl_pkey_get_private"),
    ("PHP-RSA-KEYSIZE-1024", "RSA-1024", r"private_key_bits.*1024"),
    ("PHP-RSA-KEYSIZE-2048", "RSA-2048", r"private_key_bits.*2048"),
    ("PHP-ECC-GENERATE", "ECC-generic", r"openssl_pkey_new.*EC|OPENSSL_KEYTYPE_EC"),
    ("PHP-DSA-GENERATE", "DSA-generic", r"openssl_pkey_new.*DSA|OPENSSL_KEYTYPE_DSA"),
    ("PHP-DH-GENERATE", "DH-generic", r"openssl_pkey_new.*DH|OPENSSL_KEYTYPE_DH"),
    ("PHP-DES-USE", "DES", r"openssl_encrypt\(.*DES|mcrypt_encrypt.*MCRYPT_DES"),
    ("PHP-3DES-USE", "3DES", r"openssl_encrypt\(.*des-ede3|MCRYPT_3DES"),
    ("PHP-MD5-USE", "MD5", r"""md5\(|hash\(\s*['"]md5|MD5\("""),
    ("PHP-SHA1-USE", "SHA-1", r"""sha1\(|hash\(\s*['"]sha1"""),
    ("PHP-RC4-USE", "RC4", r"openssl_encrypt\(.*rc4|MCRYPT_ARCFOUR"),
    ("PHP-BLOWFISH-USE", "Blowfish", r"openssl_encrypt\(.*bf-|MCRYPT_BLOWFISH"),
    ("PHP-ECB-MODE", "AES-128", r"openssl_encrypt\(.*ecb|MCRYPT_MODE_ECB"),
    ("PHP-WEAK-RANDOM", "RSA-generic", r"rand\(|mt_rand\(|array_rand\(|srand\(", "medium", "unknown"),
    ("PHP-MCRYPT-USE", "RSA-generic", r"mcrypt_encrypt|mcrypt_decrypt|mcrypt_module_open", "high"),
    ("PHP-PHPSECLIB-RSA", "RSA-generic", r"phpseclib.*RSA|RSA::createKey"),
    ("PHP-PHPSECLIB-DSA", "DSA-generic", r"phpseclib.*DSA|DSA::createKey"),
    ("PHP-SODIUM-USE", "AES-128", r"sodium_crypto_|SODIUM_CRYPTO_", "info", "safe"),
    ("PHP-OPENSSL-SIGN", "RSA-generic", r"openssl_sign|openssl_verify"),
    ("PHP-SSL-WEAK", "RSA-generic", r"STREAM_CRYPTO_METHOD_TLSv1_0|STREAM_CRYPTO_METHOD_SSLv3", "high"),
    ("PHP-CRYPT-USE", "RSA-generic", r"crypt\(|password_hash\(.*PASSWORD_BCRYPT"),
]

RUBY = [
    ("RB-RSA-GENERATE", "RSA-generic", r"OpenSSL::PKey::RSA\.new|OpenSSL::PKey::RSA\.generate"),
    ("RB-RSA-IMPORT", "RSA-generic", r"""require\s+['"]openssl['"].*RSA|OpenSSL::PKey::RSA"""),
    ("RB-RSA-KEYSIZE-1024", "RSA-1024", r"RSA\.new\(1024\)|RSA\.generate\(1024\)"),
    ("RB-RSA-KEYSIZE-2048", "RSA-2048", r"RSA\.new\(2048\)|RSA\.generate\(2048\)"),
    ("RB-ECC-GENERATE", "ECC-generic", r"OpenSSL::PKey::EC\.new|OpenSSL::PKey::EC\.generate"),
    ("RB-ECDSA-USE", "ECDSA-generic", r"OpenSSL::PKey::EC.*sign|ECDSA"),
    ("RB-DSA-GENERATE", "DSA-generic", r"OpenSSL::PKey::DSA\.new|OpenSSL::PKey::DSA\.generate"),
    ("RB-DH-GENERATE", "DH-generic", r"OpenSSL::PKey::DH\.new|OpenSSL::PKey::DH\.generate"),
    ("RB-DES-USE", "DES", r"""OpenSSL::Cipher::DES|OpenSSL::Cipher\.new\(['"]DES"""),
    ("RB-3DES-USE", "3DES", r"""OpenSSL::Cipher\.new\(['"]DES-EDE3|Cipher\.new\(.*3DES"""),
    ("RB-MD5-USE", "MD5", r"Digest::MD5|OpenSSL::Digest::MD5|md5\("),
    ("RB-SHA1-USE", "SHA-1", r"Digest::SHA1|OpenSSL::Digest::SHA1"),
    ("RB-RC4-USE", "RC4", r"""OpenSSL::Cipher::RC4|Cipher\.new\(['"]RC4"""),
    ("RB-BLOWFISH-USE", "Blowfish", r"""OpenSSL::Cipher::BF|Cipher\.new\(['"]BF"""),
    ("RB-ECB-MODE", "AES-128", r"Cipher\.new\(.*ECB|\.encrypt.*ECB"),
    ("RB-WEAK-RANDOM", "RSA-generic", r"rand\(|Random\.new\.rand|srand\(", "medium", "unknown"),
    ("RB-BCRYPT-USE", "RSA-generic", r"""BCrypt::Password\.create|require\s+['"]bcrypt"""),
    ("RB-SSL-WEAK", "RSA-generic", r"SSLContext\.new.*SSLv3|SSLContext\.new.*TLSv1\b", "high"),
    ("RB-CERT-VERIFY", "RSA-generic", r"verify_mode\s*=\s*OpenSSL::SSL::VERIFY_NONE", "high"),
    ("RB-RBNACL-USE", "AES-128", r"""RbNaCl::SecretBox|require\s+['"]rbnacl""", "info", "safe"),
    ("RB-AES128-USE", "AES-128", r"Cipher\.new\(.*AES-128|aes-128"),
    ("RB-HMAC-MD5", "MD5", r"HMAC\.new.*md5|OpenSSL::HMAC.*MD5"),
]

SCALA = [
    ("SC-RSA-GENERATE", "RSA-generic", r'KeyPairGenerator\.getInstance\("RSA"\)'),
    ("SC-RSA-IMPORT", "RSA-generic", r"import\s+java\.security\..*RSA|javax\.crypto.*RSA"),
    ("SC-RSA-KEYSIZE-1024", "RSA-1024", r"initialize\(1024\)|RSAKeyGenParameterSpec\(1024"),
    ("SC-RSA-KEYSIZE-2048", "RSA-2048", r"initialize\(2048\)|RSAKeyGenParameterSpec\(2048"),
    ("SC-ECC-GENERATE", "ECC-generic", r'KeyPairGenerator\.getInstance\("EC"\)'),
    ("SC-ECDSA-USE", "ECDSA-generic", r'Signature\.getInstance\(".*ECDSA'),
    ("SC-DSA-GENERATE", "DSA-generic", r'KeyPairGenerator\.getInstance\("DSA"\)'),
    ("SC-DH-GENERATE", "DH-generic", r'KeyPairGenerator\.getInstance\("DH"\)'),
    ("SC-DES-USE", "DES", r'Cipher\.getInstance\("DES|DESKeySpec'),
    ("SC-3DES-USE", "3DES", r'Cipher\.getInstance\("DESede|DESedeKeySpec'),
    ("SC-MD5-USE", "MD5", r'MessageDigest\.getInstance\("MD5"\)|DigestUtils\.md5'),
    ("SC-SHA1-USE", "SHA-1", r'MessageDigest\.getInstance\("SHA-1"\)|DigestUtils\.sha1'),
    ("SC-RC4-USE", "RC4", r'Cipher\.getInstance\("RC4"\)|Cipher\.getInstance\("ARCFOUR"\)'),
    ("SC-BLOWFISH-USE", "Blowfish", r'Cipher\.getInstance\("Blowfish"\)'),
    ("SC-ECB-MODE", "AES-128", r'Cipher\.getInstance\("[^"]*ECB|/ECB/'),
    ("SC-WEAK-RANDOM", "RSA-generic", r"scala\.util\.Random|new\s+Random\(\)", "medium", "unknown"),
    ("SC-AKKA-SSL", "RSA-generic", r"SSLContext\.getInstance|ConnectionContext\.https", "medium"),
    ("SC-BOUNCY-RSA", "RSA-generic", r"BouncyCastle.*RSA|BCRSAPrivateKey"),
    ("SC-BOUNCY-DES", "DES", r"BouncyCastle.*DES|DESedeEngine"),
    ("SC-AES128", "AES-128", r"AES.*128|SecretKeySpec.*16\s*\)"),
]

DART = [
    ("DT-RSA-GENERATE", "RSA-generic", r"RSAKeyGenerator|AsymmetricKeyPair.*RSA|generateRSAKeyPair"),
    ("DT-RSA-IMPORT", "RSA-generic", r"""import\s+['"]package:pointycastle|import.*RSA"""),
    ("DT-RSA-KEYSIZE-1024", "RSA-1024", r"bitLength.*1024|keySize.*1024"),
    ("DT-RSA-KEYSIZE-2048", "RSA-2048", r"bitLength.*2048|keySize.*2048"),
    ("DT-ECC-GENERATE", "ECC-generic", r"ECKeyGenerator|ECCurve_|ECDomainParameters"),
    ("DT-ECDSA-USE", "ECDSA-generic", r"ECDSASigner|Signer.*ECDSA"),
    ("DT-DSA-USE", "DSA-generic", r"DSASigner|DSAPublicKey|DSAPrivateKey"),
    ("DT-DH-USE", "DH-generic", r"DHKeyGenerator|DHParameters"),
    ("DT-DES-USE", "DES", r"DESEngine|DESedeEngine|DesEcb|BlockCipher.*DES"),
    ("DT-3DES-USE", "3DES", r"DESedeEngine|TripleDESEngine"),
    ("DT-MD5-USE", "MD5", r"md5\.convert|import.*package:crypto.*md5|MD5Digest|Digest.*md5"),
    ("DT-SHA1-USE", "SHA-1", r"sha1\.convert|import.*package:crypto.*sha1|SHA1Digest|Digest.*sha1"),
    ("DT-RC4-USE", "RC4", r"RC4Engine|ARC4"),
    ("DT-BLOWFISH-USE", "Blowfish", r"BlowfishEngine"),
    ("DT-ECB-MODE", "AES-128", r"ECBBlockCipher|BlockCipher.*ECB"),
    ("DT-WEAK-RANDOM", "RSA-generic", r"\bRandom\(\)(?!.*secure)", "medium", "unknown"),
    ("DT-ENCRYPT-PKG", "RSA-generic", r"""import\s+['"]package:encrypt|Encrypter\("""),
    ("DT-POINTYCASTLE", "RSA-generic", r"""import\s+['"]package:pointycastle"""),
    ("DT-SSL-CONTEXT", "RSA-generic", r"SecurityContext\(\)|SecurityContext\.defaultContext"),
    ("DT-AES128", "AES-128", r"AESFastEngine.*128|keyLength.*128"),
]

LANGUAGES = {
    "python": PYTHON,
    "java": JAVA,
    "javascript": JAVASCRIPT,
    "typescript": TYPESCRIPT,
    "golang": GOLANG,
    "cpp": CPP,
    "csharp": CSHARP,
    "rust": RUST,
    "swift": SWIFT,
    "kotlin": KOTLIN,
    "php": PHP,
    "ruby": RUBY,
    "scala": SCALA,
    "dart": DART,
}

EXTENSIONS = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "golang",
    ".c": "cpp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".h": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".php": "php",
    ".rb": "ruby",
    ".scala": "scala",
    ".sc": "scala",
    ".dart": "dart",
}
