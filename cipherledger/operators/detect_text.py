"""Line and document detectors: source code, secrets, infrastructure, containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import text_rules
from cipherledger.functions import text
from cipherledger.operators import routing
from cipherledger.operators.documents import document_rule_detector
from cipherledger.operators.hits import Builder, Rule, find, from_rows
from cipherledger.operators.lines import line_rule_detector
from cipherledger.sources import rules as rule_tables


def source_detector(
    rules: list[rule_tables.SourceRule] | None = None,
    languages: list[str] | None = None,
    severities: list[str] | None = None,
) -> Builder:
    """Cryptographic usage in source code, fourteen languages.

    ``severities`` keeps rules of these severities only: the severity of a
    source finding is the rule's, so the filter can act on the rules.
    """
    resolved = [
        Rule(rule_id, "source", severity, risk, algorithm, message, recommendation, pattern, language)
        for rule_id, _, language, pattern, severity, risk, algorithm, message, recommendation in rule_tables.resolve_rules(
            rule_tables.load_source_rules() if rules is None else rules
        )
        if (severities is None or severity in severities) and (languages is None or language in languages)
    ]
    language = routing.language_of(F.col("suffix"))
    return line_rule_detector(resolved, "source_rules", language.isNotNull(), language, 2, text.rstrip)


def secrets_detector() -> Builder:
    """Hard-coded keys, credentials and weak key material."""
    rules = from_rows(text_rules.SECRETS, "secrets", "Secret material in text")
    return line_rule_detector(rules, "secret_rules", routing.may_hold_secrets(F.col("suffix")), None, 3, text.strip)


def _documents(rows: list[tuple], subject: str, scanner: str, column: str, route) -> Builder:
    rules = from_rows([(r[0], *r[2:]) for r in rows], scanner, subject)
    return document_rule_detector(rules, {r[0]: r[1] for r in rows}, column, route)


def _iac(kind: str, rows: list[tuple], subject: str) -> Builder:
    route = routing.iac_kind(F.col("suffix"), F.col("content")) == kind
    return _documents(rows, subject, "iac", f"{kind}_rules", route)


def _container(kind: str, rows: list[tuple], subject: str) -> Builder:
    route = routing.container_kind(F.col("name"), F.col("suffix"), F.col("content")) == kind
    return _documents(rows, subject, "container", f"{kind}_rules", route)


def iac_detectors() -> list[Builder]:
    """Terraform, CloudFormation, Ansible."""
    return [
        _iac("terraform", text_rules.TERRAFORM, "Terraform"),
        _iac("cloudformation", text_rules.CLOUDFORMATION, "CloudFormation"),
        _iac("ansible", text_rules.ANSIBLE, "Ansible"),
    ]


def container_detectors() -> list[Builder]:
    """Image builds and Kubernetes manifests."""
    return [
        _container("docker", text_rules.DOCKERFILE, "Container image build"),
        _container("kubernetes", text_rules.KUBERNETES, "Kubernetes"),
    ]


def detect_source(files: DataFrame, rules=None, languages=None, severities=None) -> DataFrame:
    """D1"""
    return find(files, [source_detector(rules, languages, severities)])


def detect_secrets(files: DataFrame) -> DataFrame:
    """D8"""
    return find(files, [secrets_detector()])


def detect_terraform(files: DataFrame) -> DataFrame:
    """D9"""
    return find(files, iac_detectors()[:1])


def detect_cloudformation(files: DataFrame) -> DataFrame:
    """D10"""
    return find(files, iac_detectors()[1:2])


def detect_ansible(files: DataFrame) -> DataFrame:
    """D11"""
    return find(files, iac_detectors()[2:])


def detect_dockerfile(files: DataFrame) -> DataFrame:
    """D12"""
    return find(files, container_detectors()[:1])


def detect_kubernetes(files: DataFrame) -> DataFrame:
    """D13"""
    return find(files, container_detectors()[1:])
