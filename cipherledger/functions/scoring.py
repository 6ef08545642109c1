"""Scores and classifications of single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherledger.fixed import scoring_tables as t
from cipherledger.functions.text import lookup


def steps(value: Column, limits: list[tuple], beyond, *, at_most: bool) -> Column:
    """First label whose limit the value keeps (``at_most``) or reaches."""
    chain = None
    for limit, label in limits:
        fits = value <= limit if at_most else value >= limit
        chain = F.when(fits, F.lit(label)) if chain is None else chain.when(fits, F.lit(label))
    return chain.otherwise(F.lit(beyond))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def grade(score: Column) -> Column:
    return steps(score, [(low, name) for name, low in t.GRADES], t.LOWEST_GRADE, at_most=False)


def qvss(family: Column, risk: Column, key_size: Column, sensitivity: float = 5.0, criticality: float = 5.0,
         exposure: float = 5.0, timeline: float | None = None) -> Column:
    """Quantum vulnerability score as a struct of twelve fields."""
    vulnerability = lookup(risk, t.QVSS_RISK, 3.0)
    by_family = lookup(family, {k: v[0] for k, v in t.QVSS_FAMILY.items()}, 5.0)
    strength = (
        F.when((family != "RSA") | key_size.isNull() | (key_size == 0), by_family)
        .when(key_size <= 1024, F.lit(9.5))
        .when(key_size <= 2048, F.lit(7.0))
        .when(key_size >= 4096, F.lit(5.0))
        .otherwise(by_family)
    )
    proximity = F.lit(float(timeline)) if timeline is not None else lookup(risk, t.QVSS_TIMELINE, 5.0)
    patch = lookup(family, {k: v[1] for k, v in t.QVSS_FAMILY.items()}, 5.0)
    ten = F.lit(10.0)
    base = F.least(ten, vulnerability * 0.6 + strength * 0.4)
    temporal = F.least(ten, base * (F.lit(1.0) + (proximity - patch) * 0.05))
    surroundings = (sensitivity + criticality + exposure) / 30.0
    environmental = F.least(ten, temporal * (0.5 + surroundings * 0.5))
    overall = F.bround(environmental, 1)
    return F.struct(
        vulnerability.alias("algorithm_vulnerability"),
        strength.alias("key_strength"),
        proximity.alias("quantum_timeline_proximity"),
        patch.alias("patch_availability"),
        F.lit(float(sensitivity)).alias("data_sensitivity"),
        F.lit(float(criticality)).alias("business_criticality"),
        F.lit(float(exposure)).alias("exposure_scope"),
        F.bround(base, 1).alias("base_score"),
        F.bround(temporal, 1).alias("temporal_score"),
        overall.alias("environmental_score"),
        overall.alias("overall_score"),
        steps(overall, [(low, name) for name, low in t.QVSS_LABELS], "None", at_most=False).alias("severity_label"),
    )


def break_threshold(family: Column, key_size: Column, risk: Column) -> Column:
    """Name of the break-year row: by family and size, else by family; null when safe."""
    exact = lookup(F.concat_ws(" ", family, key_size), {f"{fam} {size}": name for fam, size, name in t.THRESHOLD_BY_KEY})
    return F.when(risk != "safe", F.coalesce(exact, lookup(family, t.THRESHOLD_BY_FAMILY)))


def timeline(family: Column, key_size: Column, risk: Column) -> Column:
    """Projected break years as a struct, null where none applies."""
    names = ("break_year_optimistic", "break_year_moderate", "break_year_conservative", "logical_qubits", "attack_type",
             "timeline_confidence")
    rows = []
    for threshold, qubits, early, middle, late, attack, confidence in t.BREAK_YEARS:
        values = (early, middle, late, qubits, attack, confidence)
        rows += [F.lit(threshold), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])]
    return F.try_element_at(F.create_map(*rows), break_threshold(family, key_size, risk))


def harvest_risk(break_year: Column, current_year: int | Column, shelf_life: int = 10, sensitivity: str = "internal") -> Column:
    """Risk that data harvested now is read later, as a struct (S3).

    The current year is a parameter, so results do not depend on the clock.
    """
    year = current_year if isinstance(current_year, Column) else F.lit(current_year)
    gap = F.lit(shelf_life) - (break_year - year)
    weight = t.SENSITIVITY_WEIGHT.get(sensitivity, 0.5)
    score = F.least(F.lit(100.0), clip((gap + 15) * 5.0, 0.0, 100.0) * F.lit(weight) * F.lit(1.5))
    return F.struct(
        gap.alias("hndl_gap"),
        F.bround(score, 1).alias("hndl_score"),
        F.when(gap > 0, F.lit("immediate")).when(gap > -5, F.lit("urgent")).when(gap > -10, F.lit("planned"))
        .otherwise(F.lit("monitor")).alias("urgency"),
    )


def base_hours(family: Column, usage: Column) -> Column:
    """Hours for a family and usage, falling back to library calls, then 4."""
    exact = lookup(F.concat_ws(" ", family, usage), {f"{fam} {use}": float(hours) for fam, use, hours in t.BASE_HOURS})
    fallback = lookup(family, {fam: float(hours) for fam, use, hours in t.BASE_HOURS if use == "library_call"})
    return F.coalesce(exact, fallback, F.lit(float(t.DEFAULT_HOURS)))


def cost(hours: Column, rate: float = t.HOURLY_RATE) -> Column:
    return F.bround(hours * F.lit(float(rate)), 2)


def complexity(hours: Column) -> Column:
    return steps(hours, t.COMPLEXITY, t.MOST_COMPLEX, at_most=True)


def file_multiplier(files: Column) -> Column:
    return steps(files, t.FILE_MULTIPLIER, t.MANY_FILES_MULTIPLIER, at_most=True)


def first_replacement(family: Column) -> Column:
    """Headline replacement of a family."""
    return lookup(family, {k: v[0][1] for k, v in t.REPLACEMENTS.items()}, t.DEFAULT_REPLACEMENT)


def vendor(usage: Column, critical: Column, fips: Column) -> Column:
    """Vendor by ordered rules, then by usage."""
    return (
        F.when(fips, F.lit("PQShield"))
        .when(usage.isin("tls_config", "certificate", "vpn"), F.lit("QuSecure"))
        .when(usage.isin("hsm", "embedded", "hardware"), F.lit("PQShield"))
        .when(critical & (usage == "key_management"), F.lit("QuSecure"))
        .otherwise(lookup(usage, t.VENDOR_BY_USE, "OpenSource"))
    )


def gate_reasons(score: Column, critical: Column, high: Column, min_score: float = 70.0, max_critical: int = 0,
                 max_high: int = 5) -> Column:
    """Why a scan fails the gate; empty when it passes."""
    return F.array_compact(F.array(
        F.when(score < min_score, F.concat(F.lit("Score "), score, F.lit(f" is below minimum {float(min_score)}"))),
        F.when(critical > max_critical, F.concat(F.lit("Critical findings: "), critical, F.lit(f" (max allowed: {max_critical})"))),
        F.when(high > max_high, F.concat(F.lit("High findings: "), high, F.lit(f" (max allowed: {max_high})"))),
    ))


def score_text(score: Column, grade_column: Column) -> Column:
    """Score for display."""
    return F.concat(F.format_string("%d", F.bround(score, 0).cast("long")), F.lit("/100 (Grade "), grade_column, F.lit(")"))


def readiness_text(share: Column) -> Column:
    return F.format_string("%d%%", F.bround(share, 0).cast("long"))


def change_text(change: Column) -> Column:
    """Direction of a score change in words."""
    points = F.concat(F.abs(change), F.lit(" points"))
    return (
        F.when(change > 0, F.concat(F.lit("Score improved by "), points))
        .when(change < 0, F.concat(F.lit("Score decreased by "), points))
        .otherwise(F.lit("Score unchanged"))
    )
