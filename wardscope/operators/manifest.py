"""The record of a matching run as tables, and its comparison with a recomputation.

A manifest is a handful of tables keyed by what they list, so none of them is one long
list inside one row and all are compared by joins:

``counters``    (name, value)                       numbers of the run
``manual``      (entity_id)                         facilities matched by hand
``exclusions``  the exclusion ledger, trimmed       facilities left out with a reason
``transitions`` (entity_id)                         matched before, excluded now
``gaps``        (province, district, ...)           regions below the quality rate
``gap_codes``   (province, district, entity_id)     the exclusions that explain a gap
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.functions.scalars import number
from wardscope.operators import contract as C
from wardscope.operators.missingness import quality_gaps

ID = ["entity_id"]
PLACE = ["province", "district"]
LEDGER = ["entity_id", "name", "reason_code", "reason", "catalog_id", "evidence_url", "confirmed_on"]
GAP = ["n_total", "n_matched", "additional_needed"]


def _counters(detail: DataFrame, staffing: DataFrame, exclusions: DataFrame, catalog: DataFrame, target: int) -> DataFrame:
    state = F.col("match_state")
    matched = state.isin(V.MATCHED_STATES)
    wide = detail.agg(
        F.count_if(matched).alias("matched"), F.count_if(state == V.STATE_AUTOMATIC).alias("automatic"),
        F.count_if(state == V.STATE_MANUAL).alias("manual"), F.count_if(~matched).alias("deferred"),
        F.coalesce(F.sum(F.when(matched, number("specialists"))), F.lit(0.0)).alias("specialist_total"),
    )
    regions = staffing.agg(F.count(F.lit(1)).alias("regional_rows"), F.count_if(F.col("quality") == V.QUALITY_OK).alias("usable_regions"))
    out = exclusions.agg(F.count(F.lit(1)).alias("excluded"))
    rows = catalog.agg(F.count(F.lit(1)).alias("catalog_rows"))
    # four tables of one row each
    one = wide.crossJoin(regions).crossJoin(out).crossJoin(rows)
    one = one.withColumn("algorithmic_deferred", F.col("deferred") - F.col("excluded")).withColumn("target_usable_regions", F.lit(target))
    return one.unpivot([], [F.col(c).cast("double").alias(c) for c in one.columns], "name", "value")


def build_manifest(
    detail: DataFrame, staffing: DataFrame, exclusions: DataFrame, catalog: DataFrame, target: int, previous: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables of the manifest of one run; ``previous`` is the match table of the run before."""
    state = F.col("match_state")
    left_out = detail.filter(state == V.STATE_EXCLUDED)
    gaps = quality_gaps(staffing, detail).select(*PLACE, *GAP)
    before = detail.limit(0) if previous is None else previous.filter(state.isin(V.MATCHED_STATES))
    return {
        "counters": _counters(detail, staffing, exclusions, catalog, target),
        "manual": detail.filter(state == V.STATE_MANUAL).select(*ID),
        "exclusions": exclusions.select(*[F.trim(F.col(c)).alias(c) for c in LEDGER]),
        "transitions": before.select(*ID).join(exclusions.select(*ID), ID, "left_semi"),
        "gaps": gaps,
        "gap_codes": left_out.select(*PLACE, *ID).join(gaps.select(*PLACE), PLACE, "left_semi"),
    }


def manifest_contract(
    manifest: dict[str, DataFrame], detail: DataFrame, staffing: DataFrame, exclusions: DataFrame, catalog: DataFrame, master: DataFrame, target: int
) -> DataFrame:
    """Every table of the manifest against its recomputation, by key; the catalogue must outnumber the population."""
    again = build_manifest(detail, staffing, exclusions, catalog, target)
    population = master.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    rows = manifest["counters"].filter("name = 'catalog_rows'").crossJoin(population)
    needed = manifest["gaps"].select(*PLACE, "additional_needed").join(manifest["gap_codes"].groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n")), PLACE, "left")
    return C.union_all(
        [
            C.unique(manifest["counters"], ["name"], "manifest_counter_name"),
            C.equal_tables(manifest["counters"], again["counters"], ["name"], ["value"], [], "manifest_counter"),
            C.holds(rows, ["name"], F.col("value") > F.col("_n"), "manifest_catalog_size", F.col("value")),
            C.same_set(manifest["manual"], again["manual"], ID, "manifest_manual"),
            C.unique(manifest["exclusions"], ID, "manifest_exclusion_id"),
            C.equal_tables(manifest["exclusions"], again["exclusions"], ID, LEDGER[1:], [], "manifest_exclusion"),
            C.subset(manifest["transitions"], exclusions, ID, "manifest_transition"),
            C.unique(manifest["gaps"], PLACE, "manifest_gap_region"),
            C.equal_tables(manifest["gaps"], again["gaps"], PLACE, GAP, [], "manifest_gap"),
            C.same_set(manifest["gap_codes"], again["gap_codes"], [*PLACE, *ID], "manifest_gap_code"),
            C.holds(needed, PLACE, F.col("additional_needed") <= F.coalesce("_n", F.lit(0)), "manifest_gap_unexplained", F.col("additional_needed")),
        ]
    )
