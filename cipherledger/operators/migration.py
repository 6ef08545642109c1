"""Migration tasks, phases and plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.fixed import scoring_tables as t
from cipherledger.functions import scoring
from cipherledger.functions.text import lookup
from cipherledger.operators.aggregate import only_scan, severity_name, top_paths
from cipherledger.operators.post import quantum_exposed, severity_order
from cipherledger.sources import rules as rule_tables


def migration_tasks(findings: DataFrame, rate: float = t.HOURLY_RATE, shown_files: int | None = None) -> DataFrame:
    """One task per algorithm family with exposed findings.

    ``migration_files`` has all files of the tasks; with ``shown_files`` each
    task lists its first ones as well.
    """
    exposed = quantum_exposed(findings)
    families = exposed.groupBy(F.col("algorithm.family").alias("from_algorithm")).agg(
        F.count("*").alias("instances"),
        severity_name(F.min(severity_order(F.col("severity")))).alias("risk_level"),
        F.max(F.col("quantum_risk") == "vulnerable").alias("vulnerable"),
        F.countDistinct("location.file_path").alias("affected_file_count"),
    )
    risk = F.when(F.col("vulnerable"), F.lit("vulnerable")).otherwise(F.lit("weakened"))
    priority = lookup(
        F.concat_ws(" ", "risk_level", risk), {" ".join(key): value for key, value in t.PRIORITY.items()}, t.DEFAULT_PRIORITY
    )
    hours = F.bround(
        scoring.base_hours(F.col("from_algorithm"), F.lit("library_call")) * scoring.file_multiplier(F.col("affected_file_count")), 1
    )
    # at most one row per family: numbering them in one task is cheap
    numbered = F.row_number().over(Window.orderBy("from_algorithm"))
    tasks = (
        families.withColumn("priority", priority)
        .withColumn("phase", lookup(F.col("priority"), t.PHASE_OF_PRIORITY))
        .withColumn("estimated_hours", hours)
        .withColumn("task_id", F.format_string("MIG-%03d", numbered))
        .withColumn("to_algorithm", scoring.first_replacement(F.col("from_algorithm")))
        .withColumn("estimated_cost_eur", scoring.cost(F.col("estimated_hours"), rate))
        .withColumn("complexity", scoring.complexity(F.col("estimated_hours")))
        .withColumn(
            "recommended_approach",
            F.when(F.col("priority") <= 2, F.lit("hybrid_transition")).otherwise(F.lit("direct_replacement")),
        )
        .withColumn("vendor_recommendation", scoring.vendor(F.lit("library_call"), F.col("priority") <= 2, F.lit(False)))
        .withColumn("title", F.concat(F.lit("Migrate "), "from_algorithm", F.lit(" to "), "to_algorithm"))
        .drop("vulnerable")
    )
    if shown_files is None:
        return tasks
    files = top_paths(exposed, F.col("algorithm.family"), "from_algorithm", shown_files, "affected_files")
    return tasks.join(files, "from_algorithm")


def migration_files(findings: DataFrame) -> DataFrame:
    """Every file of every task, one row each."""
    return quantum_exposed(findings).select(
        F.col("algorithm.family").alias("from_algorithm"), F.col("location.file_path").alias("file_path")
    ).distinct()


def migration_phases(tasks: DataFrame) -> DataFrame:
    """Hours and cost per phase that has tasks."""
    names = rule_tables.table(tasks.sparkSession, t.PHASES, "phase int, name string")
    return (
        tasks.groupBy("phase")
        .agg(F.count("*").alias("tasks"), F.sum("estimated_hours").alias("total_hours"), F.sum("estimated_cost_eur").alias("total_cost_eur"))
        .join(F.broadcast(names), "phase")
    )


def migration_plan(tasks: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Hours, cost, months, urgent tasks and a sentence.

    With ``summary`` the sentence names the findings and files as well.
    """
    totals = tasks.agg(
        F.count("*").alias("total_tasks"),
        F.countDistinct("phase").alias("phases"),
        F.coalesce(F.sum("estimated_hours"), F.lit(0.0)).alias("total_estimated_hours"),
        F.coalesce(F.sum("estimated_cost_eur"), F.lit(0.0)).alias("total_estimated_cost_eur"),
        F.count_if(F.col("priority") == 1).alias("critical_tasks"),
        F.count_if(F.col("priority") == 2).alias("high_priority_tasks"),
    ).withColumn(
        "overall_timeline_months",
        F.greatest(F.lit(1), F.floor(F.col("total_estimated_hours") / t.HOURS_PER_MONTH).cast("int") + 1),
    )
    plan_text = F.concat(
        F.col("total_tasks"), F.lit(" tasks in "), F.col("phases"), F.lit(" phases: "),
        F.format_number(F.bround("total_estimated_hours", 0), 0), F.lit(" hours, "),
        F.format_number(F.bround("total_estimated_cost_eur", 0), 0), F.lit(" EUR, "),
        F.col("overall_timeline_months"), F.lit(" months"),
    )
    if summary is None:
        return totals.withColumn("plan_text", plan_text)
    scanned = only_scan(summary, ["total_findings", "files_scanned", "score", "grade", "pqc_readiness_pct"])
    return totals.crossJoin(F.broadcast(scanned)).withColumn(
        "plan_text",
        F.concat(F.col("total_findings"), F.lit(" findings in "), F.col("files_scanned"), F.lit(" files. "), plan_text),
    )
