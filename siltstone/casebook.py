"""Entry points over one folder of Parquet tables: seed, run, list, look into, verify, challenge, score.

Everything comes back as a DataFrame, or a dict of DataFrames or settings; nothing is collected but single
rows. Tables that a run derives are written anew beside the old ones and moved into place, as they may be
read while they are computed. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import accuracy, audit, incident, search, upsert, validate
from siltstone.operators.numbering import numbered
from siltstone.plans import pipeline
from siltstone.session import write_read
from siltstone.sources.records import parse_records

EVENTS = (
    "id bigint, uid string, ts timestamp, source string, host string, user_name string, process_name string, process_id bigint, parent_process string, src_ip string, dst_ip string, "
    "file_path string, command_line string, event_code string, ocsf string, raw string"
)
EVENTS_TAKEN = ["source", "host", "user_name", "process_name", "process_id", "parent_process", "src_ip", "dst_ip", "file_path", "command_line", "event_code"]
INCIDENTS = "id bigint, title string, first_seen timestamp, last_seen timestamp, event_count bigint, raw_alert_count bigint, hosts array<string>, users array<string>, priority int, factors string, confidence double, status string"
SENTENCES = "id bigint, incident_id bigint, seq int, text string, evidence_event_ids array<bigint>, technique_id string"
VERDICTS = "sentence_id bigint, supported boolean, reason string, created_at timestamp"
TRUTH = "technique_id string"
# Why an event is evidence, by tier.
TIER_WORDS = {0: "alerting", 1: "same_process_60s", 2: "same_user_host_30s", 3: "process_lineage"}


class CaseBook:
    """The tables below root: events, alerts, incidents, entities, edges, evidence, sentences, verdicts, truth, audit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._files = self._paths.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- tables ---

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; one that is not there yet is empty."""
        path = f"{self.root}/{name}"
        if self._files.exists(self._paths.Path(path)):
            return self.spark.read.parquet(path) if schema is None else self.spark.read.schema(schema).parquet(path)
        if schema is None:
            raise FileNotFoundError(path)
        return self.spark.createDataFrame([], schema)

    def store(self, name: str, rows: DataFrame) -> None:
        """Replace a table by rows, which may be read from it."""
        new, old = self._paths.Path(f"{self.root}/{name}.new"), self._paths.Path(f"{self.root}/{name}")
        rows.write.mode("overwrite").parquet(new.toString())
        self._files.delete(old, True)
        if not self._files.rename(new, old):
            raise RuntimeError(f"could not store {name}")

    # --- writing ---

    def seed(self, lines: DataFrame, offset: Column | None = None) -> dict[str, int]:
        """Append the records of lines (uid, raw) that are not there yet; how many came in by source, how many were there or no events."""
        parsed = write_read(parse_records(lines, "uid", "raw", offset), "parsed")
        there = self.table("events", EVENTS)
        fresh = upsert.new_rows(parsed.where("reject is null"), there, "uid", ["time_us"])
        last = there.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]
        columns = ["uid", F.timestamp_micros("time_us").alias("ts"), *EVENTS_TAKEN, F.to_json("document").alias("ocsf"), "raw"]
        rows = numbered(write_read(fresh.select(columns), "fresh"), ["ts", "uid"], "id").withColumn("id", F.col("id") + F.lit(last))
        names = [f.name for f in self.table("events", EVENTS).schema]
        rows = write_read(rows.select(names), "events")
        rows.write.mode("append").parquet(f"{self.root}/events")
        counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        return counts | {"skipped": parsed.count() - sum(counts.values())}

    def run(self, rebuild: bool = False, force: bool = False) -> dict[str, int]:
        """Derive alerts, incidents, entities, edges and evidence from the events.

        Incidents keep their ids where start and hosts are the same; such without alerts go unless they
        have sentences. rebuild numbers them anew and is refused where sentences exist, unless forced.
        """
        if rebuild:
            upsert.guard_rebuild(self.table("sentences", SENTENCES), force)
        old = self.table("incidents", INCIDENTS).limit(0) if rebuild else self.table("incidents", INCIDENTS)
        done = pipeline.derive(self.table("events", EVENTS))
        found = write_read(done.incidents.select(F.col("incident").alias("_cluster"), "first_seen", "last_seen", "event_count", "raw_alert_count", "hosts", "users", "priority", F.to_json("factors").alias("factors"), "status"), "found")
        merged = write_read(upsert.upsert_incidents(old, found), "merged")
        # Two clusters of one start and the same hosts would share an id: the later one is an incident of its own.
        twin = F.row_number().over(Window.partitionBy("id").orderBy("_cluster")) > 1
        last = F.lit(merged.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0])
        twins = numbered(write_read(merged.withColumn("_t", twin).where("_t").drop("_t"), "twins"), ["_cluster"], "_no").withColumn("id", F.col("_no") + last).drop("_no")
        merged = write_read(merged.withColumn("_t", twin).where("not _t").drop("_t").unionByName(twins), "numbered-incidents")
        ids = merged.select(F.col("_cluster").alias("incident"), F.col("id").alias("incident_id"))
        kept = old.select("id", "title", "confidence")
        now = merged.join(kept, "id", "left").select([f.name for f in old.schema])
        gone = upsert.collectable(old, now, self.table("sentences", SENTENCES).select(F.col("incident_id").alias("id"))).select("id")
        stay = old.join(now.select("id"), "id", "left_anti").join(gone, "id", "left_anti")
        self.store("incidents", write_read(now.unionByName(stay), "incidents"))
        alerts = done.alerts.join(done.clusters, "id").withColumnRenamed("component", "incident")
        for name, rows in (("alerts", alerts), ("evidence", done.evidence), ("entities", done.entities), ("edges", done.edges)):
            self.store(name, rows.join(ids, "incident").drop("incident"))
        counts = {"alerts": self.table("alerts").count(), "incidents": merged.count()}
        self.note("pipeline", "deterministic_pipeline_run", counts)
        return counts

    def note(self, actor: str, action: str, detail: dict | None = None) -> str:
        """Append to the audit log."""
        return audit.append(self.spark, f"{self.root}/audit", actor, action, detail)

    def verify(self, call: Callable[[list[str]], list[str]], incident_id: int | None = None) -> DataFrame:
        """Ask a model whether sentences are supported, five at a time, replace their verdicts and return them.

        call answers prompts (JSON lists of seq and text) by JSON lists of seq, supported and reason; a
        sentence without an answer is supported if it cites anything.
        """
        rows = self.table("sentences", SENTENCES)
        rows = rows if incident_id is None else rows.where(F.col("incident_id") == incident_id)
        batches = validate.batch_numbers(rows, "incident_id", "seq")
        prompts = batches.groupBy("incident_id", "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "text")))).alias("prompt"))
        answers = validate.repaired_sentences(validate.with_model(prompts, call, "prompt").withColumn("key", F.to_json(F.struct("incident_id", "batch"))), "key", "answer")
        said = answers.select(F.from_json("key", "incident_id bigint, batch bigint").alias("k"), F.from_json("sentence", "seq int, supported boolean, reason string").alias("s"))
        said = said.select("k.incident_id", "s.*").groupBy("incident_id", "seq").agg(F.first("supported").alias("supported"), F.first("reason").alias("reason"))
        new = rows.join(said, ["incident_id", "seq"], "left").select(
            F.col("id").alias("sentence_id"), validate.supported_or_default(F.col("supported"), F.col("evidence_event_ids")).alias("supported"), "reason", F.current_timestamp().alias("created_at")
        )
        new = write_read(new, "verdicts")
        self.store("verdicts", write_read(self.table("verdicts", VERDICTS).join(new.select("sentence_id"), "sentence_id", "left_anti").unionByName(new), "all-verdicts"))
        return new

    # --- reading ---

    def audit_status(self) -> DataFrame:
        """(ok, n_entries, broken_at) of the audit log."""
        return audit.verify(self.table("audit", audit.SCHEMA))

    def incidents(self, include_suppressed: bool = False) -> DataFrame:
        """The incidents by priority, then start, then id; suppressed ones only if asked for."""
        rows = self.table("incidents", INCIDENTS)
        rows = rows if include_suppressed else rows.where("status <> 'suppressed'")
        named = F.array_join(F.when(F.size("hosts") > 0, F.col("hosts")).otherwise(F.array(F.lit("Unknown"))), ", ")
        title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Incident #"), F.col("id").cast("string"), F.lit(" ("), named, F.lit(")")))
        return rows.withColumn("title", title).orderBy(F.col("priority").desc_nulls_first(), F.col("first_seen").asc_nulls_last(), "id")

    def incident(self, incident_id: int) -> dict[str, DataFrame]:
        """One incident with its timeline, entities, edges and sentences, these with their latest verdicts."""
        head = self.incidents(True).where(F.col("id") == incident_id)
        if head.isEmpty():
            raise KeyError(f"no incident {incident_id}")
        of = F.col("incident_id") == incident_id
        alerting = self.table("evidence").where(of & (F.col("tier") == 0)).select("id", "incident_id")
        verdicts = validate.latest_verdicts(self.table("verdicts", VERDICTS), "sentence_id", "created_at", "reason").withColumnRenamed("sentence_id", "id")
        told = self.table("sentences", SENTENCES).where(of).join(verdicts, "id", "left")
        return {
            "incident": head,
            "timeline": incident.timeline(self.table("events", EVENTS).join(alerting, "id"), "incident_id"),
            "entities": self.table("entities").where(of),
            "edges": self.table("edges").where(of),
            "sentences": told.withColumn("supported", validate.supported_or_default(F.col("supported"), F.col("evidence_event_ids"))).orderBy("seq"),
        }

    def evidence(self, event_ids: list[int], incident_id: int | None = None) -> DataFrame:
        """The named events with their raw text as stored, and why they are evidence: the tier, else alerting or context."""
        rows = search.by_ids(self.table("events", EVENTS), self.spark.createDataFrame([(int(i),) for i in event_ids], "id bigint"), "id")
        alerting = self.table("alerts").select(F.col("event_id").alias("id")).distinct().withColumn("_alerting", F.lit(True))
        tiers = self.table("evidence").where(F.col("incident_id") == F.lit(incident_id)).select("id", F.create_map(*(F.lit(x) for kv in TIER_WORDS.items() for x in kv))[F.col("tier")].alias("_tier"))
        reason = F.coalesce("_tier", F.when(F.col("_alerting"), "alerting"), F.lit("context"))
        return rows.join(alerting, "id", "left").join(tiers, "id", "left").select("id", "ts", "source", "host", "event_code", "raw", reason.alias("reason")).orderBy("ts", "event_code", "id")

    def scores(self) -> dict[str, DataFrame]:
        """Recovered techniques against the truth: the numbers, the matches, what was missed, what has no support."""
        judged = (self.table("sentences", SENTENCES), self.table("verdicts", VERDICTS), self.table("incidents", INCIDENTS))
        recovered, truth = accuracy.supported_techniques(*judged), self.table("truth", TRUTH).select(F.col("technique_id").alias("id"))
        return {
            "numbers": accuracy.accuracy(recovered, truth),
            "matches": accuracy.match_techniques(recovered, truth),
            "missed": accuracy.missed(recovered, truth),
            "not_in_evidence": accuracy.unsupported_only(*judged),
        }

    def challenge(self, incident_id: int, answer: str) -> dict:
        """A model's counter-analysis (JSON) applied: the proposed filters run over the incident's events, and the confidence after it."""
        said = json.loads(answer)
        head = self.incident(incident_id)["incident"]
        change = F.lit(float(said.get("confidence_delta", -0.10)))
        shown = head.select(F.coalesce("confidence", F.lit(validate.DEFAULT_CONFIDENCE)).alias("old"), validate.updated_confidence(F.col("confidence"), change).alias("new")).first()
        members = self.table("evidence").where((F.col("incident_id") == incident_id) & (F.col("tier") == 0)).select("id", "incident_id")
        filters = (said.get("proposed_query") or {}).get("filters") or {}
        found = search.filter_search(self.table("events", EVENTS).join(members, "id"), {**filters, "incident_id": incident_id}) if filters else None
        return {**said, "old_confidence": shown["old"], "new_confidence": shown["new"], "results": found}

