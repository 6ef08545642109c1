"""Which detector reads which file (R1 to R6), and input filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.fixed import binary_rules, config_rules, source_rules, text_rules
from cipherledger.functions import text


def language_of(suffix: Column) -> Column:
    """Language by suffix (R1); null when it is not source code."""
    return text.lookup(suffix, source_rules.EXTENSIONS)


def source_files(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    wanted = [s for s, lang in source_rules.EXTENSIONS.items() if not languages or lang in languages]
    return files.where(F.col("suffix").isin(wanted)).withColumn("language", language_of(F.col("suffix")))


def config_kind(name: Column, suffix: Column) -> Column:
    """ssh, tls or null (R2)."""
    return F.when(name.isin(config_rules.SSH_NAMES), F.lit("ssh")).when(
        name.isin(config_rules.TLS_NAMES) | suffix.isin(config_rules.TLS_SUFFIXES), F.lit("tls")
    )


def ecosystem_of(name: Column) -> Column:
    """Manifest ecosystem by lower-cased name."""
    return text.lookup(F.lower(name), config_rules.MANIFEST_NAMES)


def iac_kind(suffix: Column, content: Column) -> Column:
    """terraform, cloudformation, ansible or null."""
    return F.when(
        suffix.isin(text_rules.IAC_SUFFIXES),
        F.when(suffix == ".tf", F.lit("terraform"))
        .when(text.contains_any(content, text_rules.CLOUDFORMATION_WORDS), F.lit("cloudformation"))
        .when(text.contains_any(content, text_rules.ANSIBLE_WORDS), F.lit("ansible")),
    )


def container_kind(name: Column, suffix: Column, content: Column) -> Column:
    """docker, kubernetes or null (R5). A bare Dockerfile counts as well."""
    docker = F.startswith(name, F.lit("Dockerfile")) | (name == "Containerfile")
    return F.when(docker, F.lit("docker")).when(
        suffix.isin(text_rules.CONTAINER_SUFFIXES)
        & text.contains_any(content, text_rules.KUBERNETES_WORDS),
        F.lit("kubernetes"),
    )


def may_hold_secrets(suffix: Column) -> Column:
    """Suffixes the secrets detector reads."""
    return suffix.isin(text_rules.SECRET_SUFFIXES) & ~F.lower(suffix).isin(text_rules.SECRET_SKIPPED)


def is_binary(suffix: Column, length: Column) -> Column:
    """Compiled files long enough to look at."""
    return suffix.isin(binary_rules.BINARY_SUFFIXES) & (length >= binary_rules.MIN_BINARY_BYTES)


_SUFFIXES = sorted({
    *source_rules.EXTENSIONS, *config_rules.TLS_SUFFIXES, *text_rules.SECRET_SUFFIXES, *text_rules.IAC_SUFFIXES,
    *text_rules.CONTAINER_SUFFIXES, *binary_rules.BINARY_SUFFIXES,
})
_NAMES = [*config_rules.SSH_NAMES, *config_rules.TLS_NAMES, "Containerfile"]


def is_scannable(name: Column, suffix: Column) -> Column:
    """Files at least one detector reads, by name alone."""
    return (
        suffix.isin(_SUFFIXES) | name.isin(_NAMES) | F.lower(name).isin(list(config_rules.MANIFEST_NAMES))
        | F.startswith(name, F.lit("Dockerfile"))
    )


def scannable_glob() -> str:
    """The same as a file-name glob, so that a listing opens no other file."""
    def any_case(name: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)

    manifests = [any_case(name) for name in config_rules.MANIFEST_NAMES]
    return "{" + ",".join([*(f"*{suffix}" for suffix in _SUFFIXES), *_NAMES, "Dockerfile*", *manifests]) + "}"


def at_most(files: DataFrame, megabytes: float) -> DataFrame:
    """Files up to a size; nothing but a caller's own call drops larger ones."""
    return files.where(F.col("length") <= int(megabytes * 1024 * 1024))
