"""Rule patterns: from the rule tables' dialect to the JVM's.

Rule patterns are written for Python's ``re`` over ``str``. The JVM reads them
alike under two embedded flags: ``U`` makes ``\\w \\s \\d \\b`` Unicode-aware,
``d`` lets only ``\\n`` end a line for ``.``, ``^`` and ``$``.
"""

from __future__ import annotations

import re
from re import _constants as _ops
from re import _parser as _tree

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# an escape, a named group, a reference to one; the escapes are consumed so that none is read in halves
_DIALECT = re.compile(r"\\.|\(\?P<(\w+)>|\(\?P=(\w+)\)", re.DOTALL)


def translated(pattern: str) -> str:
    """Spellings of ``re`` that the JVM has under another name: named groups and the end of the text."""
    def spelled(found: re.Match) -> str:
        name, reference = (g and "g" + g.encode().hex() for g in found.groups())
        if name:
            return f"(?<{name}>"
        if reference:
            return rf"\k<{reference}>"
        return r"\z" if found.group() == r"\Z" else found.group()

    return _DIALECT.sub(spelled, pattern)


def is_valid(pattern: str) -> bool:
    """True when the pattern compiles as it is written; ``refused`` asks the JVM, which runs it."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def jvm(pattern: str, flags: str = "") -> str:
    """The pattern with the flags that give it ``str`` semantics on the JVM."""
    return f"(?dU{flags}){translated(pattern)}"


def refused(spark: SparkSession, patterns: list[str]) -> dict[str, str]:
    """Patterns that can't run, with the reason: neither dialect's own features may be missing from the other."""
    def reason(some: list[str]) -> str | None:
        try:
            spark.range(1).select(*[F.lit("").rlike(jvm(p)) for p in some]).collect()
        except Exception as error:  # whichever class the session's kind raises
            return str(error).split("\n")[0]
        return None

    found = {p: "does not compile" for p in dict.fromkeys(patterns) if not is_valid(p)}
    rest = [p for p in dict.fromkeys(patterns) if p not in found]
    if rest and reason(rest):
        found |= {p: why for p in rest if (why := reason([p]))}
    return found


def required_literals(pattern: str, ignore_case: bool = False) -> list[str] | None:
    """Strings of which every match contains at least one; None when unsure.

    Looking for a fixed string is far cheaper than matching a pattern, so texts
    without any of these need not be matched at all. With ``ignore_case`` the
    strings are in lower case and avoid the letters whose case folding leaves
    ASCII.
    """
    try:
        tree = _tree.parse(pattern)
    except re.error:
        return None
    if tree.state.flags & re.VERBOSE or tree.state.flags & re.IGNORECASE and not ignore_case:
        return None  # flags within the pattern: its letters are not what they look like
    best = _required(tree, ignore_case)
    if best is None or min(map(len, best)) < 2:
        return None
    return sorted(best)


def _required(tree, ignore_case: bool) -> set[str] | None:
    options: list[set[str]] = []
    run = ""
    for op, argument in [*tree, (None, None)]:
        if op is _ops.LITERAL:
            char = chr(argument).lower() if ignore_case else chr(argument)
            if not ignore_case or (char.isascii() and char not in "ksi"):
                run += char
                continue
        if run:
            options.append({run})
            run = ""
        inner = None
        if op is _ops.SUBPATTERN and not argument[1]:
            inner = _required(argument[3], ignore_case)
        elif op is _ops.BRANCH:
            parts = [_required(branch, ignore_case) for branch in argument[1]]
            inner = set().union(*parts) if all(parts) else None
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and argument[0] >= 1:
            inner = _required(argument[2], ignore_case)
        if inner:
            options.append(inner)
    return max(options, key=lambda found: (min(map(len, found)), -len(found)), default=None)


def rule_structs(rules: list[tuple[int, str, str]]) -> list[tuple]:
    """Rules (position, pattern, flags) as literal structs that lambdas walk through.

    Rules as data keep the plan small whatever their number; a rule without
    required strings has the empty one, which every text contains.
    """
    return [
        (
            ("rule_ord", position),
            ("pattern", jvm(pattern, flags)),
            ("literals", required_literals(pattern, "i" in flags) or [""]),
            ("ignore_case", "i" in flags),
        )
        for position, pattern, flags in rules
    ]


def may_match(text: Column, rule: Column) -> Column:
    """False where the text lacks every required string of a rule."""
    return F.exists(rule["literals"], lambda literal: F.contains(text, literal))


def matches(text: Column, rule: Column) -> Column:
    """True where a rule's pattern is found in a text (the last pattern stays compiled)."""
    return F.regexp_instr(text, rule["pattern"]) > 0
