"""Recovered technique ids against ground truth: exact and parent or child matches, sets and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_ids(truth: DataFrame, id_col: str, replacements: DataFrame) -> DataFrame:
    """(id, shipped): ids after replacement, with the sorted shipped ids that fall together.

    replacements: old, new. An id without a replacement stays.
    """
    rows = truth.join(replacements.select(F.col("old").alias(id_col), F.col("new").alias("_new")), id_col, "left")
    rows = rows.select(F.coalesce("_new", F.col(id_col)).alias("id"), F.col(id_col).alias("shipped")).where("id is not null")
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("shipped")).alias("shipped"))


def match_techniques(recovered: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, match, truth_id): 'exact', else 'related' (parent or child; the first truth id wins), else 'beyond'.

    Relatives share the part before the dot, so they meet on an equal key.
    """
    r = recovered.select("id").where("id is not null").distinct().withColumn("_base", F.split_part("id", F.lit("."), F.lit(1)))
    t = truth.select(F.col("id").alias("truth_id")).where("truth_id is not null").distinct().withColumn("_base", F.split_part("truth_id", F.lit("."), F.lit(1)))
    related = (F.col("id") == F.col("truth_id")) | F.startswith("id", F.concat("truth_id", F.lit("."))) | F.startswith("truth_id", F.concat("id", F.lit(".")))
    pairs = r.join(t, "_base", "left").withColumn("truth_id", F.when(related, F.col("truth_id")))
    first = Window.partitionBy("id").orderBy((F.col("id") == F.col("truth_id")).desc_nulls_last(), F.col("truth_id").asc_nulls_last())
    best = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    kind = F.when(F.col("truth_id").isNull(), "beyond").when(F.col("id") == F.col("truth_id"), "exact").otherwise("related")
    return best.select("id", kind.alias("match"), "truth_id")


def missed(recovered: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth ids that nothing recovered matches."""
    found = match_techniques(recovered, truth).where("truth_id is not null").select(F.col("truth_id").alias("id"))
    return truth.select("id").where("id is not null").distinct().join(found, "id", "left_anti")


def accuracy(recovered: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_truth, n_recovered, n_exact, n_related, n_beyond, n_truth_matched, precision and recall (4 digits)."""
    m = match_techniques(recovered, truth).agg(
        F.count(F.lit(1)).alias("n_recovered"),
        F.count_if(F.col("match") == "exact").alias("n_exact"),
        F.count_if(F.col("match") == "related").alias("n_related"),
        F.count_if(F.col("match") == "beyond").alias("n_beyond"),
        F.count_distinct("truth_id").alias("n_truth_matched"),
    )
    n = truth.agg(F.count_distinct("id")).scalar()
    out = m.withColumn("n_truth", n)
    return out.withColumns({
        "precision": F.when(F.col("n_recovered") > 0, F.round((F.col("n_exact") + F.col("n_related")) / F.col("n_recovered"), 4)),
        "recall": F.when(F.col("n_truth") > 0, F.round(F.col("n_truth_matched") / F.col("n_truth"), 4)),
    })


def _judged(sentences: DataFrame, verdicts: DataFrame, incidents: DataFrame, supported: bool) -> DataFrame:
    """Sentences of surfaced incidents with a technique that have a verdict of the given kind."""
    held = verdicts.where(F.col("supported") == supported).select(F.col("sentence_id").alias("id"))
    surfaced = incidents.where(F.col("status") != "suppressed").select(F.col("id").alias("incident_id"))
    return sentences.where(F.col("technique_id").isNotNull()).join(held, "id").join(surfaced, "incident_id")


def supported_techniques(sentences: DataFrame, verdicts: DataFrame, incidents: DataFrame) -> DataFrame:
    """(id): techniques with a supported sentence in an incident that is not suppressed.

    sentences: id, incident_id, technique_id; verdicts: sentence_id, supported (several of one sentence
    are allowed); incidents: id, status. A null status surfaces nothing.
    """
    return _judged(sentences, verdicts, incidents, True).select(F.col("technique_id").alias("id")).distinct()


def unsupported_only(sentences: DataFrame, verdicts: DataFrame, incidents: DataFrame) -> DataFrame:
    """(id): techniques that were claimed but have unsupported sentences only."""
    claimed = _judged(sentences, verdicts, incidents, False).select(F.col("technique_id").alias("id")).distinct()
    return claimed.join(supported_techniques(sentences, verdicts, incidents), "id", "left_anti")


def justifications(sentences: DataFrame, verdicts: DataFrame, incidents: DataFrame, techniques: DataFrame, cited: DataFrame, events: DataFrame) -> DataFrame:
    """(technique_id, incident_id, sentence_id, event_id, process_name, command) behind the supported sentences of some techniques.

    techniques: id; cited: sentence_id, event_id; events: id, process_name, command_line, raw. The command
    is the event's, else its record's command line or message. A sentence that cites nothing has a row
    without an event.
    """
    held = _judged(sentences, verdicts, incidents, True).select("technique_id", "incident_id", F.col("id").alias("sentence_id")).distinct()
    held = held.join(techniques.select(F.col("id").alias("technique_id")).distinct(), "technique_id").join(cited.select("sentence_id", "event_id").distinct(), "sentence_id", "left")
    record = F.from_json("raw", "CommandLine string, Message string")
    command = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("command_line"), record["CommandLine"], record["Message"])), F.lit(""))
    named = events.select(F.col("id").alias("event_id"), "process_name", F.trim(command).alias("command"))
    return held.join(named, "event_id", "left").select("technique_id", "incident_id", "sentence_id", "event_id", "process_name", "command")


def unverified(sentences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(incident_id, n_unverified) of incidents with sentences: how many have no verdict."""
    done = verdicts.select(F.col("sentence_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    rows = sentences.where(F.col("incident_id").isNotNull()).join(done, "id", "left")
    return rows.groupBy("incident_id").agg(F.count_if(F.col("_done").isNull()).alias("n_unverified"))
