"""Queries over text corpora: lines, documents, detectors, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import binary_rules, config_rules, dimensions, source_rules, text_rules
from cipherledger.functions import globs, text
from cipherledger.operators import detect_binary, detect_config, detect_manifests, detect_text, lines, routing
from cipherledger.sources import files as file_sources
from cipherledger.sources import rules as rule_tables
from verification import corpus
from verification.corpus import literal, quote, sql_lookup, sql_values
from verification.registry import query

FLAT = [
    "path", "line_number", "rule_id", "severity", "quantum_risk", "algorithm", "family", "key_size", "line_content", "before", "after",
]


def flat(findings: DataFrame) -> DataFrame:
    """Findings as plain columns; neighbours joined by a bar."""
    return findings.select(
        F.col("location.file_path").alias("path"), F.col("location.line_number").alias("line_number"), "rule_id", "severity", "quantum_risk",
        F.col("algorithm.name").alias("algorithm"), F.col("algorithm.family").alias("family"), F.col("algorithm.key_size").alias("key_size"),
        F.col("location.line_content").alias("line_content"),
        F.array_join("location.context_before", "|").alias("before"), F.array_join("location.context_after", "|").alias("after"),
    )


def sql_context(width: int) -> str:
    return (
        f"array_to_string(list_slice(ls, greatest(1, n - {width}), n - 1), '|') AS before, "
        f"array_to_string(list_slice(ls, n + 1, n + {width}), '|') AS after"
    )


ALGS = sql_values(dimensions.ALGORITHMS, "algs", "name, family, key_size, algorithm_risk, replacements, deadline, description")

# -- source rules ---------------------------------------------------------------


def _source_rows() -> list[tuple]:
    return [
        (rule_id, language, key, pattern, *(list(rest) + [None, None])[:2])
        for language, rows in source_rules.LANGUAGES.items()
        for rule_id, key, pattern, *rest in rows
    ]


# DuckDB's patterns know no lookahead: the two rules that use one are stated
# over a rewritten line
LOOKAHEAD = {
    "KT-WEAK-RANDOM": r"regexp_matches(replace(line, 'kotlin.random.Random.Default.nextBytes', '#'), 'java\.util\.Random\(\)|kotlin\.random\.Random')",
    "DT-WEAK-RANDOM": r"regexp_matches(regexp_replace(line, '^.*secure', 'secure'), '\bRandom\(\)')",
}
SOURCE_RULES = sql_values(
    [r for r in _source_rows() if r[0] not in LOOKAHEAD], "rules", "rule_id, language, algorithm_key, pattern, severity_override, risk_override"
)
SOURCE_REST = " ".join(
    f"UNION ALL SELECT path, ls, n, line, {literal(r[0])}, {literal(r[2])}, {literal(r[4])}, {literal(r[5])} FROM routed "
    f"WHERE language = {literal(r[1])} AND {LOOKAHEAD[r[0]]}"
    for r in _source_rows() if r[0] in LOOKAHEAD
)
ROUTED = f"routed AS (SELECT *, {sql_lookup('suffix', source_rules.EXTENSIONS)} AS language FROM lines WHERE suffix IN {tuple(source_rules.EXTENSIONS)})"
SOURCE_HITS = f"""{corpus.CODE.sql()}, {ROUTED}, {SOURCE_RULES}, {ALGS},
hits AS (SELECT path, ls, n, line, rule_id, algorithm_key, severity_override, risk_override FROM routed JOIN rules USING (language)
  WHERE regexp_matches(line, pattern) {SOURCE_REST})"""
SEVERITY = "CASE algorithm_risk WHEN 'vulnerable' THEN 'high' WHEN 'weakened' THEN 'medium' WHEN 'safe' THEN 'info' ELSE 'low' END"
SOURCE_SQL = f"""WITH {SOURCE_HITS}
SELECT path, CAST(n AS INTEGER) AS line_number, rule_id, coalesce(severity_override, {SEVERITY}) AS severity,
  coalesce(risk_override, algorithm_risk) AS quantum_risk, name AS algorithm, family, key_size, rtrim(line) AS line_content, {sql_context(2)}
FROM hits JOIN algs ON algorithm_key = name"""


@query("source_usage", SOURCE_SQL)
def source_usage(spark, sf_dir):
    """D1"""
    return flat(detect_text.detect_source(corpus.CODE.files(spark, sf_dir)))


@query("line_rule_join", f"WITH {SOURCE_HITS} SELECT path, CAST(n AS INTEGER) AS line_number, rule_id FROM hits")
def line_rule_join(spark, sf_dir):
    """The theta join with rules as a table"""
    rules = rule_tables.table(
        spark, _source_rows(),
        "rule_id string, language string, algorithm_key string, pattern string, severity_override string, risk_override string",
    )
    numbered = lines.split_numbered(_sources(spark, sf_dir), keep=("path", "language"))
    return lines.match_lines_with_table(numbered, rules).select("path", "line_number", "rule_id")


# several languages, a rule's own algorithm, severity and risk, flags within the pattern
USER_RULES = [
    ("OWN-HASH", ["python", "java", "go"], "(?i)md5", "MD5", None, None, None),
    ("OWN-RANDOM", ["python", "php", "ruby"], "(?i)RANDOM|rand\\(", "PRNG-house", "Homegrown", "low", "weakened"),
    ("OWN-WORD", ["javascript", "typescript", "rust", "c"], "(?is)the\\b", "Plain", "Words", "info", "safe"),
]
_KNOWN = {row[0]: row for row in dimensions.ALGORITHMS}


def _user_rows() -> list[tuple]:
    rows = []
    for rule_id, languages, pattern, name, family, severity, risk in USER_RULES:
        known = _KNOWN.get(name) if family is None else None
        own_risk = known[3] if known else risk
        for language in languages:
            rows.append((rule_id, language, pattern, name, known[1] if known else family,
                         severity or dimensions.SEVERITY_OF_RISK[own_risk], risk or own_risk))
    return rows


@query("user_rules", f"""WITH {corpus.CODE.sql()}, {ROUTED}, {sql_values(_user_rows(), 'own', 'rule_id, language, pattern, algorithm, family, severity, quantum_risk')}
SELECT path, CAST(n AS INTEGER) AS line_number, rule_id, severity, quantum_risk, algorithm, family FROM routed JOIN own USING (language)
WHERE regexp_matches(line, pattern)""")
def user_rules(spark, sf_dir):
    """L3, L4, P5: a user's rules as a table, with flags, several languages and their own algorithm"""
    from cipherledger.plans.scan import detect

    rules = spark.createDataFrame(
        [(i, p, ls, n if f is None else None, s, r, None if f is None else n, f) for i, ls, p, n, f, s, r in USER_RULES],
        "rule_id string, pattern string, languages array<string>, algorithm_key string, severity string, quantum_risk string, "
        "algorithm_name string, family string",
    )
    found = detect(corpus.CODE.files(spark, sf_dir), detectors=["source"], rules=rules)
    return flat(found).select("path", "line_number", "rule_id", "severity", "quantum_risk", "algorithm", "family")


@query("line_literal_match", f"""WITH {SOURCE_HITS}
SELECT path, CAST(n AS INTEGER) AS line_number, rule_id, coalesce(severity_override, {SEVERITY}) AS severity FROM hits JOIN algs ON algorithm_key = algs.name""")
def line_literal_match(spark, sf_dir):
    """L3, L4: patterns as literals over a table of lines"""
    rules = rule_tables.resolve_rules(rule_tables.load_source_rules())
    numbered = lines.split_numbered(_sources(spark, sf_dir), keep=("path", "language"))
    return lines.match_lines(numbered, rules).select("path", "line_number", "rule_id", "severity")


def _sources(spark, sf_dir):
    return routing.source_files(corpus.CODE.files(spark, sf_dir))


@query("rule_resolution", f"""WITH {corpus.CODE.sql()}, {sql_values(_source_rows(), 'rules', 'rule_id, language, algorithm_key, pattern, severity_override, risk_override')}, {ALGS},
uses AS (SELECT {sql_lookup('suffix', source_rules.EXTENSIONS)} AS language, count(*) AS files, sum(length(content)) AS characters FROM files GROUP BY 1)
SELECT rule_id, language, name AS algorithm, coalesce(severity_override, {SEVERITY}) AS severity, coalesce(risk_override, algorithm_risk) AS quantum_risk,
  family, files, CAST(characters AS BIGINT) AS characters FROM rules JOIN algs ON algorithm_key = name JOIN uses USING (language)""")
def rule_resolution(spark, sf_dir):
    """Every language's rules, with how much text of the corpus they are read over"""
    rules = rule_tables.table(spark, rule_tables.resolve_rules(rule_tables.load_source_rules()), rule_tables.RESOLVED)
    uses = _sources(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("characters"))
    return uses.join(F.broadcast(rules), "language").select(
        "rule_id", "language", F.col("algorithm.name").alias("algorithm"), "severity", "quantum_risk", F.col("algorithm.family").alias("family"),
        "files", "characters",
    )


@query("language_filter", f"""WITH {corpus.CODE.sql()} SELECT language, count(*) AS files FROM (
  SELECT {sql_lookup('suffix', source_rules.EXTENSIONS)} AS language FROM files) WHERE language IN ('cpp', 'kotlin', 'dart') GROUP BY 1""")
def language_filter(spark, sf_dir):
    """R1"""
    return routing.source_files(corpus.CODE.files(spark, sf_dir), ["cpp", "kotlin", "dart"]).groupBy("language").agg(F.count("*").alias("files"))


# -- lines ------------------------------------------------------------------------

DOC_FILES = f"""split AS (SELECT doc_id, string_split_regex(text, '{corpus.LINE_BREAK_SQL}') AS parts FROM documents),
whole AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM split),
lines AS (SELECT doc_id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM whole)"""


def _documents(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


@query("numbered_lines", f"WITH {DOC_FILES} SELECT doc_id AS path, CAST(n AS INTEGER) AS line_number, line FROM lines")
def numbered_lines(spark, sf_dir):
    """L1"""
    return lines.split_numbered(_documents(spark, sf_dir))


@query("context_windows", f"WITH {DOC_FILES} SELECT doc_id AS path, CAST(n AS INTEGER) AS line_number, {sql_context(3)} FROM lines")
def context_windows(spark, sf_dir):
    """L2"""
    return lines.number_lines(_documents(spark, sf_dir), width=3).select(
        "path", "line_number", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after")
    )


@query("running_section", f"""WITH {corpus.PYTHON_MANIFESTS.sql()} SELECT path, CAST(n AS INTEGER) AS line_number,
  last_value(CASE WHEN line LIKE '[%' THEN lower(trim(line, '[]')) END IGNORE NULLS)
    OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM lines""")
def running_section(spark, sf_dir):
    """L8, W6"""
    numbered = lines.split_numbered(corpus.PYTHON_MANIFESTS.files(spark, sf_dir))
    marker = F.when(F.startswith("line", F.lit("[")), F.lower(F.btrim(F.col("line"), F.lit("[]"))))
    return detect_manifests.running_marker(numbered, marker, "section").select("path", "line_number", "section")


@query("uncommented_settings", f"""WITH {corpus.SSH.sql()} SELECT path, CAST(n AS INTEGER) AS line_number, line FROM lines
WHERE trim(line, ' ' || chr(9)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9)), '#')""")
def uncommented_settings(spark, sf_dir):
    """R10"""
    return detect_config.without_comments(lines.split_numbered(corpus.SSH.files(spark, sf_dir)))


@query("directive_tokens", f"""WITH {corpus.TLS.sql()}, t AS (SELECT path, n, unnest(regexp_split_to_array(line, '[:, ]+')) AS token,
  generate_subscripts(regexp_split_to_array(line, '[:, ]+'), 1) AS i FROM lines)
SELECT path, CAST(n AS INTEGER) AS line_number, CAST(i - 1 AS INTEGER) AS position, regexp_replace(token, '^[+!-]+', '') AS name FROM t
WHERE NOT regexp_matches(token, '^[!-]')""")
def directive_tokens(spark, sf_dir):
    """L9"""
    numbered = lines.split_numbered(corpus.TLS.files(spark, sf_dir))
    tokens = numbered.select(
        "path", "line_number", F.posexplode(detect_config.directive_tokens(F.col("line"), "[:, ]+")).alias("position", "token")
    )
    return tokens.where(~detect_config.is_switched_off(F.col("token"))).select(
        "path", "line_number", "position", detect_config.without_prefix(F.col("token")).alias("name")
    )


@query("joined_continuations", """SELECT doc_id, md5(replace(replace(text, 'the' || chr(10), 'the' || chr(92) || chr(10)), chr(92) || chr(10), ' ')) AS digest
FROM documents""")
def joined_continuations(spark, sf_dir):
    """L7"""
    folded = F.replace("text", F.lit("the\n"), F.lit("the\\\n"))
    return corpus.read(spark, sf_dir, "documents").select("doc_id", F.md5(detect_config.join_continuations(folded)).alias("digest"))


PEM = corpus.Corpus(
    names=("bundle.pem",), every=3,
    snippets=("-----BEGIN CERTIFICATE-----", "MIIBdata", "-----END CERTIFICATE-----", "MIICmore"),
)
# a block: from the last begin marker before an end marker up to that end marker
PEM_SQL = f"""WITH {PEM.sql()},
parts AS (SELECT path, string_split(content, '-----BEGIN CERTIFICATE-----')[2:] AS ps FROM files),
blocks AS (SELECT path, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM parts),
closed AS (SELECT path, i, concat('-----BEGIN CERTIFICATE-----', string_split(p, '-----END CERTIFICATE-----')[1], '-----END CERTIFICATE-----') AS pem
  FROM blocks WHERE contains(p, '-----END CERTIFICATE-----'))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS cert_index, length(pem) AS size, md5(pem) AS digest FROM closed"""


@query("pem_blocks", PEM_SQL)
def pem_blocks(spark, sf_dir):
    """L10"""
    from cipherledger.operators.detect_endpoints import split_pem

    return split_pem(PEM.files(spark, sf_dir)).select(
        "path", "cert_index", F.length("pem").cast("long").alias("size"), F.md5("pem").alias("digest")
    )


# -- document rules ---------------------------------------------------------------


def document_sql(source: corpus.Corpus, where: str, rows: list[tuple]) -> str:
    """Matches by cutting at each match and adding up lengths."""
    flagged = [(r[0], f"(?{r[1]})" + r[2] if r[1] else r[2], *r[3:], i) for i, r in enumerate(rows)]
    rules = sql_values(flagged, "rules", "rule_id, pattern, algorithm, family, quantum_risk, severity, rule_ord")
    branches = " UNION ALL ".join(
        f"SELECT path, content, ls, {literal(r[0])} AS rule_id, regexp_extract_all(content, {literal(p)}, 0) AS ms, "
        f"string_split_regex(content, {literal(p)}) AS gs FROM chosen"
        for r, (_, p, *_rest) in zip(rows, flagged)
    )
    return f"""WITH {source.sql()}, {rules},
chosen AS (SELECT path, content, ls FROM whole WHERE {where}),
cut AS ({branches}),
each AS (SELECT path, content, ls, rule_id, unnest(range(1, len(ms) + 1)) AS k, ms, gs FROM cut),
placed AS (SELECT path, ls, rule_id, k,
  list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS start, content FROM each),
spots AS (SELECT path, ls, rule_id, k, CAST(length(left(content, CAST(start AS BIGINT))) - length(replace(left(content, CAST(start AS BIGINT)), chr(10), '')) + 1 AS INTEGER) AS n FROM placed)
SELECT path, n AS line_number, rule_id, severity, quantum_risk, algorithm, family, CAST(NULL AS INTEGER) AS key_size,
  trim(ls[n], ' ' || chr(9)) AS line_content, {sql_context(3)} FROM spots JOIN rules USING (rule_id)"""


def words_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


IAC = f"suffix IN {tuple(text_rules.IAC_SUFFIXES)}"
CFN = f"{IAC} AND suffix <> '.tf' AND {words_sql('content', text_rules.CLOUDFORMATION_WORDS)}"
ANS = f"{IAC} AND suffix <> '.tf' AND NOT {words_sql('content', text_rules.CLOUDFORMATION_WORDS)} AND {words_sql('content', text_rules.ANSIBLE_WORDS)}"
DOCKER = "(starts_with(name, 'Dockerfile') OR name = 'Containerfile')"
K8S = f"NOT {DOCKER} AND suffix IN {tuple(text_rules.CONTAINER_SUFFIXES)} AND {words_sql('content', text_rules.KUBERNETES_WORDS)}"


@query("terraform_settings", document_sql(corpus.TERRAFORM, "suffix = '.tf'", text_rules.TERRAFORM))
def terraform_settings(spark, sf_dir):
    """D9, L5"""
    return flat(detect_text.detect_terraform(corpus.TERRAFORM.files(spark, sf_dir)))


@query("cloudformation_settings", document_sql(corpus.CLOUDFORMATION, CFN, text_rules.CLOUDFORMATION))
def cloudformation_settings(spark, sf_dir):
    """D10"""
    return flat(detect_text.detect_cloudformation(corpus.CLOUDFORMATION.files(spark, sf_dir)))


@query("ansible_settings", document_sql(corpus.ANSIBLE, ANS, text_rules.ANSIBLE))
def ansible_settings(spark, sf_dir):
    """D11"""
    return flat(detect_text.detect_ansible(corpus.ANSIBLE.files(spark, sf_dir)))


@query("dockerfile_settings", document_sql(corpus.DOCKER, DOCKER, text_rules.DOCKERFILE))
def dockerfile_settings(spark, sf_dir):
    """D12"""
    return flat(detect_text.detect_dockerfile(corpus.DOCKER.files(spark, sf_dir)))


@query("kubernetes_settings", document_sql(corpus.KUBERNETES, K8S, text_rules.KUBERNETES))
def kubernetes_settings(spark, sf_dir):
    """D13"""
    return flat(detect_text.detect_kubernetes(corpus.KUBERNETES.files(spark, sf_dir)))


# -- secrets ------------------------------------------------------------------------

SECRET_RULES = sql_values(text_rules.SECRETS, "rules", "rule_id, pattern, algorithm, family, quantum_risk, severity")
SECRETS_SQL = f"""WITH {corpus.CODE.sql()}, {SECRET_RULES}
SELECT path, CAST(n AS INTEGER) AS line_number, rule_id, severity, quantum_risk, algorithm, family, CAST(NULL AS INTEGER) AS key_size,
  trim(line, ' ' || chr(9)) AS line_content, {sql_context(3)} FROM lines, rules
WHERE suffix IN {tuple(text_rules.SECRET_SUFFIXES)} AND lower(suffix) NOT IN {tuple(text_rules.SECRET_SKIPPED)} AND regexp_matches(line, pattern)"""


@query("secret_material", SECRETS_SQL)
def secret_material(spark, sf_dir):
    """D8, R6"""
    return flat(detect_text.detect_secrets(corpus.CODE.files(spark, sf_dir)))


# -- SSH and TLS settings -----------------------------------------------------------

CONFIG_SEVERITY = (
    f"CASE algorithm_risk WHEN 'vulnerable' THEN CASE WHEN family IN {tuple(config_rules.CRITICAL_IN_CONFIG)} THEN 'critical' ELSE 'high' END "
    "WHEN 'weakened' THEN 'medium' ELSE 'low' END"
)
SSH_SQL = f"""WITH {corpus.SSH.sql()}, {sql_values(config_rules.SSH_TOKENS, 'weak', 'directive, token, algorithm_key')}, {ALGS},
bare AS (SELECT *, trim(line, ' ' || chr(9)) AS b FROM lines WHERE name IN {tuple(config_rules.SSH_NAMES)}),
parsed AS (SELECT *, lower(regexp_extract(b, '^(\\S+)\\s*=?\\s*(.*)', 1)) AS directive, regexp_extract(b, '^(\\S+)\\s*=?\\s*(.*)', 2) AS value
  FROM bare WHERE b <> '' AND NOT starts_with(b, '#')),
tokens AS (SELECT *, lower(unnest(regexp_split_to_array(trim(value, ' ' || chr(9)), '[,\\s]+'))) AS token FROM parsed)
SELECT path, CAST(n AS INTEGER) AS line_number, concat('ssh-weak-', directive, '-', token) AS rule_id, {CONFIG_SEVERITY} AS severity,
  algorithm_risk AS quantum_risk, algs.name AS algorithm, family, key_size, line AS line_content, {sql_context(2)}
FROM tokens JOIN weak USING (directive, token) JOIN algs ON algorithm_key = algs.name"""


@query("ssh_settings", SSH_SQL)
def ssh_settings(spark, sf_dir):
    """D2, R2"""
    return flat(detect_config.detect_ssh(corpus.SSH.files(spark, sf_dir)))


# one directive per line in this corpus, so the SQL side may read line by line
_CIPHER_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(token, {literal('(?i)' + p.replace('(?!.*3)', ''))})"
    + (" AND NOT regexp_matches(token, '(?i)(^|[-_:!])DES([-_]CBC|[-_]|$).*3')" if "(?!" in p else "")
    + f" THEN {literal(key)}"
    for p, key in config_rules.WEAK_CIPHER_NAMES
) + " END"
_DIRECTIVES = [(k, "(?i)" + p) for k, p in config_rules.TLS_DIRECTIVES]
TLS_SQL = f"""WITH {corpus.TLS.sql()}, {ALGS}, {sql_values(config_rules.WEAK_PROTOCOLS, 'protocols', 'protocol, severity')},
chosen AS (SELECT path, ls, line, n FROM lines WHERE (name IN {tuple(config_rules.TLS_NAMES)} OR suffix IN {tuple(config_rules.TLS_SUFFIXES)})
  AND NOT starts_with(trim(line), '#')),
settings AS ({" UNION ALL ".join(
    f"SELECT path, ls, line, n, {literal(k)} AS kind, regexp_extract(line, {literal(p)}, 1) AS value FROM chosen WHERE regexp_matches(line, {literal(p)})"
    for k, p in _DIRECTIVES)}),
tokens AS (SELECT path, ls, line, n, kind, unnest(regexp_split_to_array(value, CASE kind WHEN 'protocols' THEN '[\\s,]+' ELSE '[:, \\t]+' END)) AS raw FROM settings),
kept AS (SELECT path, ls, line, n, kind, regexp_replace(raw, '^[+!-]+', '') AS token FROM tokens WHERE raw <> '' AND NOT regexp_matches(raw, '^[!-]')),
judged AS (SELECT k.*, p.severity AS protocol_severity, CASE WHEN kind = 'protocols' THEN CASE WHEN p.severity IS NOT NULL THEN 'RSA-generic' END ELSE {_CIPHER_CASE} END AS algorithm_key
  FROM kept k LEFT JOIN protocols p ON k.kind = 'protocols' AND lower(k.token) = p.protocol)
SELECT path, CAST(n AS INTEGER) AS line_number,
  CASE WHEN kind = 'protocols' THEN concat('tls-weak-protocol-', lower(token)) ELSE concat('tls-weak-cipher-', lower(algorithm_key), '-', lower(token)) END AS rule_id,
  CASE WHEN kind = 'protocols' THEN protocol_severity ELSE {CONFIG_SEVERITY} END AS severity,
  CASE WHEN kind = 'protocols' THEN 'vulnerable' ELSE algorithm_risk END AS quantum_risk, name AS algorithm, family, key_size,
  line AS line_content, {sql_context(2)} FROM judged JOIN algs ON algorithm_key = name"""


@query("tls_settings", TLS_SQL)
def tls_settings(spark, sf_dir):
    """D3"""
    return flat(detect_config.detect_tls(corpus.TLS.files(spark, sf_dir)))


# -- manifests ------------------------------------------------------------------------


def _library_sql(rows: list[tuple]) -> str:
    expanded = [(n, r[0], i, r[2], r[3], r[4]) for i, r in enumerate(rows) for n in r[1]]
    return sql_values(expanded, "libs", "known, rule_id, lib_ord, algorithm_key, quantum_risk, severity")


MANIFEST_COLUMNS = """path, CAST(n AS INTEGER) AS line_number, rule_id, severity, quantum_risk, name AS algorithm, family, key_size,
  trim(ls[n], ' ' || chr(9)) AS line_content, '' AS before, '' AS after"""
_B = "trim(line, ' ' || chr(9))"
PYTHON_SQL = f"""WITH {corpus.PYTHON_MANIFESTS.sql()}, {_library_sql(config_rules.PYTHON_LIBRARIES)}, {ALGS},
b AS (SELECT path, lower(name) AS manifest, ls, n, {_B} AS b FROM lines),
marked AS (SELECT *, CASE manifest
  WHEN 'pipfile' THEN CASE WHEN starts_with(b, '[') THEN lower(trim(b, '[]')) IN ('packages', 'dev-packages') END
  WHEN 'pyproject.toml' THEN CASE WHEN regexp_matches(b, '^(dependencies|optional-dependencies\\.\\w+)\\s*=\\s*\\[') THEN TRUE
    WHEN starts_with(b, '[') OR b = ']' THEN FALSE END
  WHEN 'setup.cfg' THEN CASE WHEN starts_with(b, '[') THEN FALSE WHEN regexp_matches(b, '^install_requires\\s*=') THEN TRUE
    WHEN b = '' OR contains(b, '=') THEN FALSE END END AS mark FROM b),
state AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS inside FROM marked),
read AS (SELECT *, CASE manifest
  WHEN 'requirements.txt' THEN CASE WHEN NOT regexp_matches(b, '^[#-]') THEN regexp_extract(b, '^([A-Za-z0-9][-A-Za-z0-9_.]*)', 1) END
  WHEN 'pipfile' THEN CASE WHEN inside AND mark IS NULL AND contains(b, '=') THEN trim(trim(trim(string_split(b, '=')[1]), '"'), '''') END
  WHEN 'pyproject.toml' THEN CASE WHEN inside AND mark IS NULL THEN regexp_extract(b, '^["'']([A-Za-z0-9][-A-Za-z0-9_.]*)', 1) END
  WHEN 'setup.cfg' THEN CASE WHEN mark THEN regexp_extract(trim(regexp_replace(b, '^[^=]*=', '')), '^([A-Za-z0-9][-A-Za-z0-9_.]*)', 1)
    WHEN inside AND mark IS NULL THEN regexp_extract(b, '^([A-Za-z0-9][-A-Za-z0-9_.]*)', 1) END END AS package FROM state)
SELECT {MANIFEST_COLUMNS} FROM read JOIN libs ON lower(regexp_replace(package, '[-_.]+', '-', 'g')) = known JOIN algs ON algorithm_key = name"""


@query("python_dependencies", PYTHON_SQL)
def python_dependencies(spark, sf_dir):
    """D4, L8, R3"""
    return flat(detect_manifests.detect_python_manifests(corpus.PYTHON_MANIFESTS.files(spark, sf_dir)))


_NODE_LIST = literal(list(corpus.NODE_NAMES))
NODE_SQL = f"""WITH {_library_sql(config_rules.NODE_LIBRARIES)}, {ALGS},
made AS (SELECT concat('repo', doc_id % 20, '/n', doc_id, '/package.json') AS path, concat('{{', chr(10), '"dependencies": {{', chr(10),
  array_to_string(list_distinct_in_order, ',' || chr(10)), chr(10), '}}', chr(10), CASE WHEN doc_id % 5 = 4 THEN '' ELSE '}}' END) AS content, doc_id
  FROM (SELECT doc_id, list_transform(range(0, len(string_split(text, chr(10)))), lambda i:
    concat('  "', ({_NODE_LIST})[CAST((doc_id + i * 3) % {len(corpus.NODE_NAMES)} AS INTEGER) + 1], '": "', i, '"')) AS list_distinct_in_order FROM documents)),
valid AS (SELECT * FROM made WHERE doc_id % 5 <> 4),
keyed AS (SELECT path, string_split(content, chr(10)) AS ls, unnest(list_distinct(json_keys(content, '$.dependencies'))) AS key FROM valid),
placed AS (SELECT path, ls, key, list_position(list_transform(ls, lambda l: contains(l, concat('"', key, '"'))), TRUE) AS n FROM keyed)
SELECT {MANIFEST_COLUMNS} FROM placed JOIN libs ON key = known JOIN algs ON algorithm_key = name"""


def node_files(spark, sf_dir):
    d = F.col("doc_id")
    names = F.array(*[F.lit(n) for n in corpus.NODE_NAMES])
    entries = F.transform(
        F.split("text", "\n"),
        lambda _, i: F.concat(F.lit('  "'), F.get(names, ((d + i * 3) % len(corpus.NODE_NAMES)).cast("int")), F.lit('": "'), i, F.lit('"')),
    )
    # every fifth file lacks its last brace
    content = F.concat(
        F.lit('{\n"dependencies": {\n'), F.array_join(entries, ",\n"), F.lit("\n}\n"), F.when(d % 5 == 4, F.lit("")).otherwise(F.lit("}"))
    )
    rows = corpus.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("repo"), d % 20, F.lit("/n"), d, F.lit("/package.json")).alias("path"), content.alias("content")
    )
    return file_sources.with_names(rows.withColumn("length", F.octet_length("content").cast("long")))


@query("node_dependencies", NODE_SQL)
def node_dependencies(spark, sf_dir):
    """D5"""
    return flat(detect_manifests.detect_node_manifests(node_files(spark, sf_dir)))


JAVA_SQL = f"""WITH {corpus.POM.sql()}, {_library_sql(config_rules.JAVA_LIBRARIES)}, {ALGS},
b AS (SELECT path, lower(name) AS manifest, ls, n, {_B} AS b FROM lines WHERE lower(name) IN ('pom.xml', 'build.gradle', 'build.gradle.kts')),
blocks AS (SELECT *, sum(CASE WHEN contains(b, '<dependency>') THEN 1 ELSE 0 END) OVER w AS block,
  CASE WHEN contains(b, '</dependency>') THEN 1 ELSE 0 END AS closing FROM b WHERE manifest = 'pom.xml' WINDOW w AS (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING)),
open AS (SELECT *, sum(closing) OVER (PARTITION BY path, block ORDER BY n ROWS UNBOUNDED PRECEDING) AS closed FROM blocks WHERE block > 0),
read AS (SELECT path, any_value(ls) AS ls, block, min(n) AS n, max(closed) AS closed,
  arg_max(nullif(regexp_extract(b, '<groupId>\\s*(.+?)\\s*</groupId>', 1), ''), n) FILTER (closed = 0 AND NOT contains(b, '<dependency>') AND contains(b, '<groupId>')) AS grp,
  arg_max(nullif(regexp_extract(b, '<artifactId>\\s*(.+?)\\s*</artifactId>', 1), ''), n) FILTER (closed = 0 AND NOT contains(b, '<dependency>') AND contains(b, '<artifactId>')) AS art
  FROM open GROUP BY path, block),
deps AS (SELECT path, ls, n, CASE WHEN grp IS NOT NULL THEN concat(grp, ':', coalesce(art, '')) ELSE art END AS dep FROM read WHERE closed > 0
  UNION ALL SELECT path, ls, n, coalesce(nullif(regexp_extract(b, '{config_rules.GRADLE_SCOPES}\\s+[''"]([^''"]+)[''"]', 1), ''),
    nullif(regexp_extract(b, '{config_rules.GRADLE_SCOPES}\\s+group:\\s*[''"]([^''"]+)[''"]', 1), '')) FROM b WHERE manifest <> 'pom.xml'),
hits AS (SELECT path, ls, n, rule_id, severity, quantum_risk, algorithm_key, row_number() OVER (PARTITION BY path, rule_id ORDER BY n) AS r
  FROM deps JOIN libs ON contains(lower(dep), known))
SELECT {MANIFEST_COLUMNS} FROM hits JOIN algs ON algorithm_key = name WHERE r = 1"""


@query("java_dependencies", JAVA_SQL)
def java_dependencies(spark, sf_dir):
    """D6"""
    return flat(detect_manifests.detect_java_manifests(corpus.POM.files(spark, sf_dir)))


GO_SQL = f"""WITH {corpus.GO_MOD.sql()}, {_library_sql(config_rules.GO_LIBRARIES)}, {ALGS},
b AS (SELECT path, ls, n, {_B} AS b FROM lines WHERE lower(name) = 'go.mod'),
marked AS (SELECT *, CASE WHEN starts_with(b, 'require') AND contains(b, '(') THEN TRUE WHEN b = ')' THEN FALSE END AS mark FROM b),
state AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS inside FROM marked),
modules AS (SELECT *, CASE WHEN mark THEN NULL WHEN inside THEN CASE WHEN b <> ')' AND NOT starts_with(b, '//') THEN regexp_extract(b, '^(\\S+)', 1) END
  ELSE regexp_extract(b, '^require\\s+(\\S+)\\s+', 1) END AS module FROM state),
hits AS (SELECT path, ls, n, l.*, row_number() OVER (PARTITION BY path, n ORDER BY lib_ord) AS r FROM modules JOIN libs l ON starts_with(module, known))
SELECT {MANIFEST_COLUMNS} FROM hits JOIN algs ON algorithm_key = name WHERE r = 1"""


@query("go_dependencies", GO_SQL)
def go_dependencies(spark, sf_dir):
    """D7"""
    return flat(detect_manifests.detect_go_manifests(corpus.GO_MOD.files(spark, sf_dir)))


# -- binaries ------------------------------------------------------------------------


def _binary_files(spark, sf_dir):
    return corpus.BINARY_TEXT.files(spark, sf_dir).withColumn("content", F.encode("content", "UTF-8"))


_STRING_ROWS = [(i, *row) for i, row in enumerate(binary_rules.STRINGS)]
STRINGS_SQL = f"""WITH {corpus.BINARY_TEXT.sql()}, found AS ({" UNION ALL ".join(
    f"SELECT path, content, {literal(rule_id)} AS rule_id, {literal(severity)} AS severity, {literal(risk)} AS quantum_risk, {literal(family)} AS algorithm, "
    f"regexp_extract(content, {literal(pattern)}, 0) AS m, string_split_regex(content, {literal(pattern)})[1] AS g FROM files "
    f"WHERE strlen(content) >= 64 AND regexp_matches(content, {literal(pattern)})"
    for rule_id, pattern, family, risk, severity in binary_rules.STRINGS)})
SELECT path, rule_id, severity, quantum_risk, algorithm, CAST(strlen(g) AS INTEGER) AS line_number,
  concat('offset 0x', lower(to_hex(CAST(strlen(g) AS BIGINT))), ': ', m) AS line_content FROM found"""


@query("binary_strings", STRINGS_SQL)
def binary_strings(spark, sf_dir):
    """D14, L6"""
    found = flat(detect_binary.detect_strings(_binary_files(spark, sf_dir)))
    return found.select("path", "rule_id", "severity", "quantum_risk", "algorithm", "line_number", "line_content")


SYMBOLS_SQL = f"""WITH {corpus.BINARY_TEXT.sql()}, {sql_values(binary_rules.SYMBOLS, 'symbols', 'symbol, rule_id, algorithm, quantum_risk, severity')}
SELECT path, rule_id, severity, quantum_risk, algorithm, 0 AS line_number, concat('Symbol: ', symbol) AS line_content
FROM files, symbols WHERE strlen(content) >= 64 AND contains(content, symbol)"""


@query("binary_symbols", SYMBOLS_SQL)
def binary_symbols(spark, sf_dir):
    """D15"""
    found = flat(detect_binary.detect_symbols(_binary_files(spark, sf_dir)))
    return found.select("path", "rule_id", "severity", "quantum_risk", "algorithm", "line_number", "line_content")


# Blobs: per document a run of 256-byte blocks, one per line of its text. A block
# holds every byte value once (8 bits), or two values in turn (1 bit); document
# and position decide which, and how many of a file are hot.
def blobs(spark, sf_dir):
    d = F.col("doc_id")
    hex2 = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex(i), 2, "0"))
    table = F.array_join(hex2, "")
    flat_block = F.repeat(F.lit("00FF"), 128)
    body = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.size(F.split("text", "\n")) + 1),
            lambda i: F.when((d * 5 + i * 3) % (2 + d % 4) == 0, table).otherwise(flat_block),
        ),
        "",
    )
    rows = corpus.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("bin/b"), d, F.lit(".so")).alias("path"), F.unhex(body).alias("content")
    )
    return file_sources.with_names(rows.withColumn("length", F.octet_length("content").cast("long")))


ENTROPY_SQL = """WITH b AS (SELECT concat('bin/b', doc_id, '.so') AS path, doc_id, len(string_split(text, chr(10))) + 2 AS blocks,
  unnest(range(0, len(string_split(text, chr(10))) + 2)) AS i FROM documents),
hot AS (SELECT path, blocks, i * 256 AS place FROM b WHERE (doc_id * 5 + i * 3) % (2 + doc_id % 4) = 0 AND i < blocks - 1),
ranked AS (SELECT *, count(*) OVER (PARTITION BY path) AS hits, row_number() OVER (PARTITION BY path ORDER BY place) AS r FROM hot)
SELECT path, CAST(place AS INTEGER) AS line_number, 'BIN-ENTROPY-HIGH' AS rule_id,
  concat('offset 0x', lower(to_hex(CAST(place AS BIGINT))), ': entropy=8.00 bits/byte') AS line_content FROM ranked WHERE hits <= blocks * 0.5 AND r <= 5"""


@query("binary_entropy", ENTROPY_SQL)
def binary_entropy(spark, sf_dir):
    """D16, S8, W5"""
    found = flat(detect_binary.detect_entropy(blobs(spark, sf_dir), shown=5))
    return found.select("path", "line_number", "rule_id", "line_content")


@query("entropy_regions", ENTROPY_SQL.replace(" AND r <= 5", ""))
def entropy_regions(spark, sf_dir):
    """Every region of every file"""
    found = flat(detect_binary.detect_entropy(blobs(spark, sf_dir)))
    return found.select("path", "line_number", "rule_id", "line_content")


@query("line_entropy", f"""WITH {DOC_FILES}, chars AS (SELECT doc_id, n, unnest(string_split(line, '')) AS ch, length(line) AS size FROM lines WHERE line <> ''),
counts AS (SELECT doc_id, n, size, ch, count(*) AS c FROM chars WHERE ch <> '' GROUP BY ALL)
SELECT doc_id AS path, CAST(n AS INTEGER) AS line_number, round(-sum((c / size) * log2(c / size)), 6) AS bits FROM counts GROUP BY ALL""")
def line_entropy(spark, sf_dir):
    """S8"""
    numbered = lines.split_numbered(_documents(spark, sf_dir)).where(F.col("line") != "")
    return numbered.select("path", "line_number", F.round(text.string_entropy(F.col("line")), 6).alias("bits"))


# -- routing and sources ------------------------------------------------------------


@query("config_routing", f"""WITH {corpus.TLS.sql()} SELECT kind, count(*) AS files FROM (SELECT CASE WHEN name IN {tuple(config_rules.SSH_NAMES)} THEN 'ssh'
  WHEN name IN {tuple(config_rules.TLS_NAMES)} OR suffix IN {tuple(config_rules.TLS_SUFFIXES)} THEN 'tls' END AS kind FROM files) GROUP BY 1""")
def config_routing(spark, sf_dir):
    """R2"""
    files = corpus.TLS.files(spark, sf_dir)
    return files.groupBy(routing.config_kind(F.col("name"), F.col("suffix")).alias("kind")).agg(F.count("*").alias("files"))


@query("manifest_routing", f"""WITH {corpus.PYTHON_MANIFESTS.sql()} SELECT {sql_lookup('lower(name)', config_rules.MANIFEST_NAMES)} AS ecosystem, name, count(*) AS files
FROM files GROUP BY ALL""")
def manifest_routing(spark, sf_dir):
    """R3"""
    files = corpus.PYTHON_MANIFESTS.files(spark, sf_dir)
    return files.groupBy(routing.ecosystem_of(F.col("name")).alias("ecosystem"), "name").agg(F.count("*").alias("files"))


@query("infrastructure_routing", f"""WITH {corpus.ANSIBLE.sql()} SELECT path, CASE WHEN {CFN} THEN 'cloudformation' WHEN {ANS} THEN 'ansible' END AS kind FROM files""")
def infrastructure_routing(spark, sf_dir):
    """R4"""
    return corpus.ANSIBLE.files(spark, sf_dir).select("path", routing.iac_kind(F.col("suffix"), F.col("content")).alias("kind"))


@query("container_routing", f"""WITH {corpus.DOCKER.sql()} SELECT path, CASE WHEN {DOCKER} THEN 'docker' WHEN {K8S} THEN 'kubernetes' END AS kind FROM files""")
def container_routing(spark, sf_dir):
    """R5"""
    return corpus.DOCKER.files(spark, sf_dir).select(
        "path", routing.container_kind(F.col("name"), F.col("suffix"), F.col("content")).alias("kind")
    )


@query("file_suffixes", f"WITH {corpus.CODE.sql()} SELECT suffix, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM files GROUP BY 1")
def file_suffixes(spark, sf_dir):
    """P1, R6"""
    return corpus.CODE.files(spark, sf_dir).groupBy("suffix").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


EXCLUDES = ["repo1*/", "!repo12/", "tests/", "*.kt", "/repo3/src/*.py", "lib/**/*.js", "**/app/f?.go"]
_EXCLUDE_SQL = "FALSE"
for _pattern in EXCLUDES:
    _regex = globs.to_regex(_pattern.lstrip("!"))
    _EXCLUDE_SQL = f"CASE WHEN regexp_matches(path, {literal(_regex)}) THEN {literal(not _pattern.startswith('!'))} ELSE {_EXCLUDE_SQL} END"


@query("excluded_paths", f"WITH {corpus.CODE.sql()} SELECT path FROM files WHERE NOT ({_EXCLUDE_SQL})")
def excluded_paths(spark, sf_dir):
    """P2"""
    return file_sources.excluding(corpus.CODE.files(spark, sf_dir), EXCLUDES).select("path")


@query("decoded_text", "SELECT doc_id, md5(text) AS digest, length(text) AS size FROM documents")
def decoded_text(spark, sf_dir):
    """Bytes that are not UTF-8 are put between the characters and must vanish"""
    bad = F.unhex(F.lit("FFC3"))
    noisy = F.concat(bad, F.encode("text", "UTF-8"), F.unhex(F.lit("FE")))
    rows = corpus.read(spark, sf_dir, "documents").select("doc_id", noisy.alias("content"))
    clean = file_sources.as_text(rows)
    return clean.select("doc_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))


@query("nontrivial_files", "SELECT doc_id AS path FROM documents WHERE trim(text) <> '' AND strlen(text) BETWEEN 64 AND 5000")
def nontrivial_files(spark, sf_dir):
    """P4"""
    files = _documents(spark, sf_dir).withColumn("length", F.octet_length("content"))
    return file_sources.not_trivial(files, 64, 5000).select("path")
