"""The deterministic pipeline: detect, gather beacons, number, deduplicate, correlate, roll up, collect evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import beacon, correlate, dedup, incident, rules
from siltstone.session import spread, table, write_read


@dataclass
class Pipeline:
    alerts: DataFrame
    clusters: DataFrame
    incidents: DataFrame
    entities: DataFrame
    edges: DataFrame
    evidence: DataFrame


def found_alerts(hits: DataFrame) -> DataFrame:
    """Alerts of the hits, script-host connections as one alert per beacon session. Hits are written once."""
    return beacon.session_alerts(write_read(hits, "hits"))


def marked_alerts(hits: DataFrame) -> DataFrame:
    """Numbered alerts of the hits with exact and near-duplicates marked in one greedy pass."""
    alerts = write_read(rules.number_alerts(found_alerts(hits)), "alerts")
    return dedup.apply_marks(alerts, dedup.mark_greedy(alerts))


def exact_alerts(hits: DataFrame) -> DataFrame:
    """Numbered alerts, every hit by itself, with exact duplicates alone marked."""
    alerts = rules.number_alerts(hits)
    key = dedup.exact_key(F.col("rule_id"), F.col("host"), F.col("user_norm"), F.col("process_uid"), F.col("ts"))
    return dedup.mark_exact(alerts.withColumn("dedup_key", key))


def fields_of(events: DataFrame) -> DataFrame:
    """event_fields, written once: detection and evidence read them."""
    return write_read(rules.event_fields(spread(events.select(*rules.EVENT_COLUMNS))), "fields")


def run(spark: SparkSession, sf_dir: str, documented: bool = False) -> Pipeline:
    """All derived tables of the telemetry."""
    return derive(table(spark, sf_dir, "telemetry"), documented)


def derive(events: DataFrame, documented: bool = False) -> Pipeline:
    """All derived tables of events. Documents are read once; alerts, clusters and evidence are written once.

    The incident of a cluster has the id of the cluster's first alert. event_count is the size of its evidence.
    """
    fields = fields_of(events)
    alerts = write_read(marked_alerts(rules.fired(fields, codes=rules.CANDIDATE_CODES)), "marked")
    clusters = write_read(correlate.correlate(alerts, documented), "clusters")
    grouped = alerts.join(clusters, "id").withColumnRenamed("component", "incident")
    evidence = write_read(incident.evidence(fields, grouped.select("event_id", "incident"), "incident"), "evidence")
    counts = evidence.groupBy("incident").agg(F.count(F.lit(1)).alias("event_count"))
    found = incident.incidents(grouped, "incident").join(counts, "incident", "left")
    told = evidence.select("incident", "id").join(events.drop("incident_id", "incident"), "id")
    return Pipeline(alerts, clusters, found, incident.entities(told, "incident"), incident.entity_edges(told, "incident"), evidence)
