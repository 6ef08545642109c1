"""Text as columns: decoding, lines, context windows, trimming, entropy."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def decode_utf8(raw: Column) -> Column:
    """Bytes as text; malformed sequences are left out, replacement characters of the text's own stay."""
    text = raw.cast("string")
    sign, mark = F.lit("\ufffd"), F.lit("\ufdd0\ufdd1\ufdd0")
    repaired = F.replace(F.make_valid_utf8(F.replace(text, sign, mark)), sign, F.lit(""))
    repaired = F.replace(repaired, mark, sign)
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def decode_latin1(raw: Column) -> Column:
    """Bytes as text with one character per byte, so positions are byte offsets."""
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def split_lines(content: Column) -> Column:
    """Lines of a text as an array, without an empty line after a final break."""
    rare = contains_any(content, RARE_BREAKS)
    parts = F.when(rare, F.split(content, LINE_BREAK, -1)).otherwise(F.split(content, "\n", -1))
    return let(
        parts,
        lambda found: F.when(
            F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)
        ).otherwise(found),
    )


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_at(lines: Column, number: Column) -> Column:
    """Line by 1-based number; empty beyond the end."""
    return F.coalesce(F.get(lines, number - 1), F.lit(""))


def context_before(lines: Column, number: Column, width: int) -> Column:
    return F.slice(lines, F.greatest(F.lit(1), number - width), F.least(F.lit(width), number - 1))


def context_after(lines: Column, number: Column, width: int) -> Column:
    return F.slice(lines, number + 1, F.lit(width))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def suffix_of(name: Column) -> Column:
    """Last extension with its dot; empty for dotfiles and names ending in a dot."""
    return F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)


def contains_any(column: Column, words: list[str]) -> Column:
    """True where a plain column contains one of the words."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(column, F.lit(word))
    return test


def mentions(value: Column, words: list[str]) -> Column:
    """The same for a computed value, by one pattern, so that it is worked out once and in generated code."""
    return value.rlike("|".join(rf"\Q{word}\E" for word in words))


def _plain(value):
    """A value for JSON: structs, given as tuples of (name, value), become objects."""
    if isinstance(value, tuple):
        return {name: _plain(part) for name, part in value}
    if isinstance(value, list):
        return [_plain(part) for part in value]
    if isinstance(value, dict):
        return {str(key): _plain(part) for key, part in value.items()}
    return value


def _ddl(value) -> str:
    if isinstance(value, tuple):
        return "struct<" + ",".join(f"{name}:{_ddl(part)}" for name, part in value) + ">"
    if isinstance(value, list):
        return f"array<{_ddl(value[0]) if value else 'string'}>"
    if isinstance(value, dict):
        return f"map<string,{_ddl(next(iter(value.values())))}>"
    return {bool: "boolean", int: "int", float: "double", str: "string"}[type(value)]


def constant(value) -> Column:
    """A nested Python value as one literal column.

    It is written as JSON, which the optimizer reads once: the plan holds two
    nodes until then and one literal after, however large the table. Structs
    are tuples of (name, value); map keys are strings.
    """
    return F.from_json(F.lit(json.dumps(_plain(value), ensure_ascii=False)), _ddl(value))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, as one lookup in a literal map."""
    found = F.try_element_at(constant(table), key.cast("string"))
    return found if default is None else F.coalesce(found, F.lit(default))


def shannon_entropy(counts: Column, total: Column) -> Column:
    """Bits per symbol from an array of symbol counts."""
    return -F.aggregate(
        counts, F.lit(0.0), lambda acc, n: acc + (n / total) * F.log2(n / total)
    )


def string_entropy(text: Column) -> Column:
    """Shannon entropy of a string; 0 for an empty one."""
    symbols = F.filter(F.array_distinct(F.split(text, "")), lambda ch: ch != "")

    def of_size(size):
        counts = F.transform(symbols, lambda ch: size - F.length(F.replace(text, ch, F.lit(""))))
        return shannon_entropy(counts, size)

    # the length is worked out once, not anew for every symbol
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.length(text).cast("double"), of_size))
