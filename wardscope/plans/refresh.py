"""The two jobs a user runs: feed refresh and full refresh.

Both take landed tables, recompute what lies below them, write a new version,
check the written tables against every contract whose inputs are there, and move
the pointer only if nothing is violated.  Tables that several later steps read
are written once in between.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscope.functions import fixed_values as V
from wardscope.operators import clusters, contract, manifest, missingness, publication, score, snapshot, statistics
from wardscope.session import cut_lineage
from wardscope.sources import sinks

COMPONENTS = list(V.RISK_WEIGHTS)
REGRESSION = ["s_load", "road_km", "residents_per_bed", "s_staff"]


@dataclass
class Inputs:
    """Landed tables of one run, under canonical column names."""

    master: DataFrame
    feed: DataFrame
    previous: DataFrame
    failed_regions: DataFrame
    history: DataFrame
    residents: DataFrame
    staffing: DataFrame
    access_routes: DataFrame
    matches: DataFrame | None = None
    region_ledger: DataFrame | None = None
    match_review: DataFrame | None = None
    match_staffing: DataFrame | None = None
    match_queues: tuple[DataFrame, DataFrame] | None = None
    route_origins: DataFrame | None = None
    route_candidates: DataFrame | None = None
    route_best: DataFrame | None = None
    route_facilities: DataFrame | None = None
    facility_routes: DataFrame | None = None
    polygons: DataFrame | None = None
    boundary_source: DataFrame | None = None
    overrides: DataFrame | None = None
    exclusions: DataFrame | None = None
    catalog: DataFrame | None = None
    match_manifest: dict[str, DataFrame] | None = None
    feed_order: list[str] = field(default_factory=lambda: ["seq"])
    previous_order: list[str] = field(default_factory=lambda: ["seq"])


@dataclass
class Limits:
    minimum_live: int = V.MIN_LIVE_MATCHES
    retention_days: int | None = 30
    complete_regions: int = 0
    max_clusters: int = 8
    cluster_restarts: int = 20
    entities: int | None = None
    regions: int | None = None
    resident_period: str | None = None
    boundaries: int | None = None
    boundary_version: str | None = None
    usable_regions: int = 0
    logic_version: str | None = None


#: What a table of route origins carries when it was made from boundaries.
ORIGIN_COLUMNS = {"base_lat", "base_lon", "adjust_km", "probe_status", "boundary_version", "method", "origin_key"}


def component_tables(snapshot_rows: DataFrame, inputs: Inputs) -> dict[str, DataFrame]:
    """Load, access, resident and staff components of a snapshot; all are region-level tables."""
    rows = snapshot.region_of(snapshot_rows)
    totals = rows.groupBy("region_key").agg(F.sum("total").alias("total_beds"))
    residents = snapshot.region_of(inputs.residents).select("region_key", "population")
    staff = snapshot.region_of(inputs.staffing).groupBy("region_key").agg(F.sum("specialists").alias("specialists"))
    return {
        "load": score.load_component(rows),
        "access": score.percentile_score(inputs.access_routes, "road_km", "s_access"),
        "population": score.population_component(residents, totals),
        "staff": score.staff_component(staff, totals),
    }


def refresh_tables(inputs: Inputs, now, limits: Limits | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(tables, audit) of one run, nothing checked or published yet."""
    limits = limits or Limits()
    rows, audit = snapshot.build_snapshot(
        inputs.master, inputs.feed, inputs.previous, inputs.failed_regions, now, inputs.feed_order, inputs.previous_order, limits.minimum_live
    )
    rows = cut_lineage(rows)
    parts = {name: cut_lineage(df) for name, df in component_tables(rows, inputs).items()}
    risk = cut_lineage(score.composite_risk(parts["load"], parts["access"], parts["population"], parts["staff"]))
    history = snapshot.append_history(inputs.history, rows, ["status"])
    history = cut_lineage(snapshot.trim_history(history, "collected_ts", snapshot.moment(now), limits.retention_days))
    evaluation, labelled = clusters.choose_clusters(risk, COMPONENTS, limits.max_clusters, restarts=limits.cluster_restarts)
    measures = parts["access"].select("region_key", "road_km").join(parts["population"].select("region_key", "residents_per_bed"), "region_key", "full")
    model = risk.join(measures, "region_key", "left")
    coefficients, fit = statistics.linear_regression(model, "region_key", REGRESSION, "risk")
    tables = {
        "snapshot": rows, "history": history, **{f"component_{n}": df for n, df in parts.items()}, "risk": risk,
        "missingness": missingness.missingness_report(rows, risk, inputs.matches),
        "heatmap": statistics.heatmap(history),
        "correlation": statistics.correlation_matrix(risk, [*COMPONENTS, "risk"]),
        "inflation": statistics.variance_inflation(risk, COMPONENTS),
        "regression": coefficients, "cluster_evaluation": evaluation, "clusters": labelled,
        "cluster_profile": clusters.cluster_profile(labelled, [*COMPONENTS, "risk"]),
    }
    return tables, {**audit, "regression": fit}


def gate(tables: dict[str, DataFrame], inputs: Inputs, limits: Limits | None = None) -> DataFrame:
    """Violations of all contracts that the tables and inputs allow to check; publication needs none."""
    limits = limits or Limits()
    rows, risk, master = tables["snapshot"], tables["risk"], inputs.master
    checks = [
        publication.snapshot_contract(rows, master, limits.minimum_live),
        contract.risk_contract(risk, floor=limits.complete_regions),
        contract.same_set(risk, snapshot.region_of(master), ["region_key"], "risk_population"),
        publication.report_contract(tables["missingness"], missingness.missingness_report(rows, risk, inputs.matches)),
    ]
    if not tables["cluster_evaluation"].isEmpty():  # with too little data the cluster tables are empty by design
        checks.append(publication.serving_contract(risk, tables["clusters"], rows, master, REGRESSION, REGRESSION))
    if limits.entities is not None and {"lat", "lon"} <= set(master.columns):
        checks.append(publication.master_contract(master, limits.entities, limits.regions))
    if inputs.region_ledger is not None:
        checks.append(publication.region_ledger_contract(inputs.region_ledger, master))
    if {"admin_code", "period"} <= set(inputs.residents.columns):
        checks.append(publication.resident_contract(inputs.residents, master, limits.resident_period))
    if inputs.match_staffing is not None:
        checks.append(publication.risk_table_contract(risk, master, inputs.match_staffing, limits.complete_regions))
    if inputs.matches is not None and inputs.match_review is not None:
        checks.append(publication.match_contract(inputs.matches, master, inputs.match_review, inputs.match_staffing, *inputs.match_queues, limits.logic_version, inputs.overrides, inputs.exclusions))
    if inputs.matches is not None and inputs.match_staffing is not None:
        checks.append(publication.explained_quality_contract(inputs.match_staffing, inputs.matches))
    if inputs.match_manifest is not None:
        checks.append(
            manifest.manifest_contract(inputs.match_manifest, inputs.matches, inputs.match_staffing, inputs.exclusions, inputs.catalog, master, limits.usable_regions)
        )
    if inputs.boundary_source is not None:
        checks.append(publication.boundary_source_contract(inputs.boundary_source, limits.boundary_version))
    if inputs.route_origins is not None and ORIGIN_COLUMNS <= set(inputs.route_origins.columns):
        checks.append(publication.origin_contract(inputs.route_origins, master, limits.boundary_version))
    if inputs.route_candidates is not None:
        checks.append(publication.candidate_bounds_contract(inputs.route_candidates, inputs.route_facilities))
        access = tables["component_access"].join(inputs.access_routes.drop("road_km"), "region_key", "left")
        checks.append(
            publication.route_contract(inputs.route_origins, inputs.route_candidates, inputs.route_best, access, inputs.route_facilities, inputs.facility_routes, master)
        )
    if inputs.polygons is not None:
        checks.append(publication.boundary_contract(inputs.polygons, snapshot.region_of(master).select("region_key").distinct(), limits.boundaries, limits.boundary_version))
    return contract.union_all(checks)


def publish_refresh(spark: SparkSession, inputs: Inputs, now, root: str, version: str, limits: Limits | None = None) -> dict:
    """Run, write, check what was written, and publish; returns the audit."""
    tables, audit = refresh_tables(inputs, now, limits)
    sinks.publish(spark, tables, lambda written: gate(written, inputs, limits), root, version)
    return audit
