"""What a rotation over targets guarantees, in closed form.

Cohort c takes ``limit`` targets from place ``c * limit`` on, around a circle of n.  Laid end to end the cohorts are consecutive
places, and target i is at places ``i + k * n``, so it is in the cohorts ``floor((i + k * n) / limit)``: everything below follows from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """Of positive longs: Euclid's steps, of which a long needs at most 92."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.greatest(s["b"], F.lit(1))).alias("b")))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def coverage_proof(registries: DataFrame, targets: str = "registry_targets", limit: str = "targets_per_cohort") -> DataFrame:
    """``registries`` with what their rotation does; a limit outside 1 to the number of targets is an error.

    ``selection_period_cohorts``: after so many cohorts the rotation begins anew; ``visits_per_target_min`` and ``_max`` in a period;
    ``max_revisit_gap_cohorts`` and ``worst_case_full_coverage_cohorts`` from any start, both the number of cohorts whose places make a circle.
    """
    n, m = F.col(targets).cast("long"), F.col(limit).cast("long")
    fits = F.coalesce((m >= 1) & (m <= n), F.lit(False))
    n = F.when(fits, n).otherwise(F.raise_error(F.lit("coverage limit must be within the registry's size")).cast("long"))
    common = greatest_common_divisor(n, m)
    rows = registries.withColumn("__g", common)
    circle = F.ceil(F.col(targets) / F.col(limit)).cast("long")
    whole = lambda a: F.floor(a / F.col("__g")).cast("long")
    visits = whole(F.col(limit))
    return rows.withColumns({
        "selection_period_cohorts": whole(F.col(targets)), "visits_per_target_min": visits, "visits_per_target_max": visits, "max_revisit_gap_cohorts": circle,
        "worst_case_full_coverage_cohorts": circle, "all_targets_reached": F.lit(True), "deterministic_wraparound": F.lit(True),
    }).drop("__g")


def visits(registries: DataFrame, targets: str = "registry_targets", limit: str = "targets_per_cohort") -> DataFrame:
    """A row per target and visit in a period: ``target`` (from 0), ``cohort`` and ``gap`` to its next visit, around the period's end."""
    known = coverage_proof(registries, targets, limit)
    n, m = F.col(targets).cast("long"), F.col(limit).cast("long")
    each = known.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("visits_per_target_min") - 1)))
    at = lambda k: F.floor((F.col("target") + k * n) / m).cast("long")
    return each.select(*registries.columns, "target", at(F.col("__k")).alias("cohort"), (at(F.col("__k") + 1) - at(F.col("__k"))).alias("gap"))
