"""Lines of texts and rules over them (L1, L2, L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.functions import patterns, text
from cipherledger.operators.hits import Builder, Detector, Rule, line_hit, none
from cipherledger.sources import rules as rule_tables


def number_lines(files: DataFrame, width: int = 2, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per line with its number and ``width`` neighbours on both sides.

    The windows are cut from the text's own line array before it is unrolled,
    so no line is shuffled and no row carries the whole text.
    """
    texts = files.select(*keep, text.split_lines(F.col("content")).alias("lines"))
    return texts.select(
        *keep,
        F.inline(
            F.transform(
                F.col("lines"),
                lambda line, i: F.struct(
                    (i + 1).alias("line_number"),
                    line.alias("line"),
                    text.context_before(F.col("lines"), i + 1, width).alias("context_before"),
                    text.context_after(F.col("lines"), i + 1, width).alias("context_after"),
                ),
            )
        ),
    )


def split_numbered(files: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per line, without neighbours."""
    return files.select(
        *keep, F.posexplode(text.split_lines(F.col("content"))).alias("position", "line")
    ).select(*keep, (F.col("position") + 1).alias("line_number"), "line")


def rule_hits(rules: list[tuple], test) -> Column:
    """Orders of the rules whose test holds, as an array of literals' CASEs."""
    return F.array_remove(
        F.array(*[F.when(test(rule), F.lit(rule[1])).otherwise(F.lit(-1)) for rule in rules]), -1
    )


def _by_language(rules: list[tuple], language: Column | None, test) -> Column:
    if language is None:
        return rule_hits(rules, test)
    groups: dict[str, list[tuple]] = {}
    for rule in rules:
        groups.setdefault(rule[2], []).append(rule)
    chain = None
    for name, members in groups.items():
        found = rule_hits(members, test)
        chain = F.when(language == name, found) if chain is None else chain.when(language == name, found)
    return chain.otherwise(F.array().cast("array<int>"))


def match_lines(lines: DataFrame, rules: list[tuple], language: str | None = "language") -> DataFrame:
    """Every (line, rule) pair whose pattern is found in the line (L3).

    Patterns are literals, so each is compiled once per task. Only the rules of
    the line's language are tried, and only on lines that hold one of the
    strings a rule requires.
    """
    def test(rule):
        found, literals = F.col("line").rlike(patterns.jvm(rule[3])), patterns.required_literals(rule[3])
        return text.contains_any(F.col("line"), literals) & found if literals else found

    found = _by_language(rules, F.col(language) if language else None, test)
    hits = lines.withColumn("rule_ord", F.explode(found))
    return hits.join(F.broadcast(rule_tables.table(lines.sparkSession, rules, rule_tables.RESOLVED)
                                 .drop("language", "pattern")), "rule_ord")


def match_lines_with_table(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The same pairs for rules that are a table: a theta join.

    ``rules`` needs columns language and pattern; tables beyond ``MAX_RULES`` are
    refused. The rules become one literal per language that a lambda walks
    through, so a line meets a pattern only if it holds one of its strings, and
    what else the table says comes from one broadcast join.
    """
    held = rules.limit(rule_tables.MAX_RULES + 1).collect()
    by_language: dict[str, list[tuple]] = {}
    for order, rule in enumerate(held):
        by_language.setdefault(rule["language"], []).append((order, rule["pattern"], ""))
    numbered = rule_tables.table(
        lines.sparkSession, [(order, *rule) for order, rule in enumerate(held)],
        T.StructType([T.StructField("rule_ord", T.IntegerType()), *rules.schema.fields]),
    )
    if not held:
        return lines.join(numbered.drop("rule_ord"), "language")
    tables = text.constant({name: patterns.rule_structs(rows) for name, rows in by_language.items()})
    hits = F.filter(
        F.try_element_at(tables, F.col("language")),
        lambda rule: patterns.may_match(F.col("line"), rule) & patterns.matches(F.col("line"), rule),
    )
    found = lines.withColumn("rule_ord", F.explode(F.transform(hits, lambda rule: rule["rule_ord"])))
    return found.join(F.broadcast(numbered.drop("language")), "rule_ord").drop("rule_ord")


def line_rule_detector(rules: list[Rule], column: str, route: Column, language: Column | None, width: int, trim) -> Builder:
    """Rules over the lines of a text, in two steps (L1 to L3).

    First the text as a whole is searched for the strings its rules require;
    most texts lack them all and are never cut. Only for the rules left are the
    lines tried, again by required string first and then by pattern, and the
    neighbours of the hits taken.
    """
    def build(first: int) -> Detector:
        if not rules:
            return Detector(rules=[], hits=none())
        numbered = [(first + i, r.pattern, "") for i, r in enumerate(rules)]
        if language is None:
            applicable = text.constant(patterns.rule_structs(numbered))
        else:
            groups: dict[str, list[tuple]] = {}
            for rule, row in zip(rules, numbered):
                groups.setdefault(rule.language, []).append(row)
            tables = {name: patterns.rule_structs(rows) for name, rows in groups.items()}
            applicable = F.try_element_at(text.constant(tables), language)
        lines = F.col("lines")

        def of_rule(rule):
            def is_hit(n):
                line = text.line_at(lines, n)
                return patterns.may_match(line, rule) & patterns.matches(line, rule)

            numbers = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), is_hit)
            return F.transform(numbers, lambda n: line_hit(rule["rule_ord"], n, width, trim, a=n, b=rule["rule_ord"] - first))

        possible = F.filter(applicable, lambda rule: patterns.may_match(F.col("content"), rule))
        return Detector(
            rules=rules,
            prepared={column: F.when(route, possible)},
            wants_lines=F.size(column) > 0,
            hits=F.when(F.size(column) > 0, F.flatten(F.transform(column, of_rule))),
        )

    return build
