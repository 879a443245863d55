"""Incidents from clusters: roll-up, priority, status, timeline, entities, edges and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.keys import host_key, user_key
from siltstone.functions.normalize import is_correlating_user, is_machine_account, routable_ip, windows_path
from siltstone.operators.rules import DOCUMENT, first_filled, with_document
from siltstone.operators.timestamps import pinned
from siltstone.session import write_read

# Points of the priority score and the rules that earn them.
FACTORS = (
    ("credential-access", 30, ("CUR-005", "CUR-018")),
    ("lateral-movement", 20, ("CUR-012", "CUR-017", "CUR-021")),
    ("external-connection", 15, ("CUR-004", "CUR-013")),
    ("persistence", 10, ("CUR-006", "CUR-007", "CUR-008", "CUR-009", "CUR-010", "CUR-014")),
)
HOSTS_POINTS, TACTIC_POINTS, MOST_TACTIC_POINTS, MOST_POINTS = 25, 5, 20, 100
EVIDENCE_CAP, USER_CAP, PROCESS_PAD_S, USER_PAD_S = 250, 60, 60, 30
HANDLE_CODES = ("4656", "4658", "4663", "4690")


def rollup(alerts: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: first_seen, last_seen, hosts, users (no computers), raw_alert_count and the rules.

    Duplicates count. Sets are of hosts, users and rules of one incident, not of alerts.
    """
    user = F.when(~is_machine_account(F.col("user_norm")), F.col("user_norm"))
    return alerts.groupBy(cluster).agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif(F.col("host"), F.lit("-")))).alias("hosts"),
        F.array_sort(F.collect_set(user)).alias("users"),
        F.count(F.lit(1)).alias("raw_alert_count"),
        F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.array_sort(F.collect_set("tactic")).alias("tactics"),
        F.max(F.col("severity").isin("high", "critical")).alias("has_severe"),
    )


def priority(rules: Column, hosts: Column, tactics: Column) -> tuple[Column, Column]:
    """(score, factors) of a set of rules: an additive score up to 100 and the points it consists of."""
    parts = [F.when(F.arrays_overlap(rules, F.array(*map(F.lit, ids))), F.struct(F.lit(name).alias("factor"), F.lit(points).alias("points"))) for name, points, ids in FACTORS]
    parts.insert(1, F.when(F.size(hosts) > 1, F.struct(F.lit("several-hosts").alias("factor"), F.lit(HOSTS_POINTS).alias("points"))))
    extra = F.least(F.lit(MOST_TACTIC_POINTS), (F.size(tactics) - 1) * TACTIC_POINTS)
    parts.append(F.when(F.size(tactics) > 1, F.struct(F.lit("several-tactics").alias("factor"), extra.alias("points"))))
    factors = F.filter(F.array(*parts), lambda p: p.isNotNull())
    score = F.least(F.lit(MOST_POINTS), F.aggregate(factors, F.lit(0), lambda acc, p: acc + p["points"]))
    return score, factors


def status(score: Column, raw_count: Column, has_severe: Column, least_alerts: int = 3) -> Column:
    """'open' for what deserves to surface, else 'suppressed'."""
    return F.when((score > 0) & ((raw_count >= least_alerts) | F.coalesce(has_severe, F.lit(False))), "open").otherwise("suppressed")


def incidents(alerts: DataFrame, cluster: str) -> DataFrame:
    """The roll-up with priority, factors and status."""
    rows = rollup(alerts, cluster)
    score, factors = priority(F.col("rules"), F.col("hosts"), F.col("tactics"))
    rows = rows.withColumns({"priority": score, "factors": factors})
    return rows.withColumn("status", status(F.col("priority"), F.col("raw_alert_count"), F.col("has_severe")))


def timeline(rows: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """rows with position (from 1) in the order (ts, event code as text, id) of each group."""
    code = F.coalesce(*(F.col(c) for c in ("event_code", "rule_id") if c in rows.columns), F.lit(""))
    order = Window.partitionBy(group).orderBy(F.col("ts").asc_nulls_last(), code, id_col)
    return rows.withColumn("position", F.row_number().over(order))


def named_things(events: DataFrame, group: str) -> DataFrame:
    """(group, id, ts, things, links): arrays of the (kind, value) and (src, dst, relation) that each event names.

    What a column lacks, the event document fills in, where there is one.
    """
    columns = [group, "id", "ts", "host", "user_name", "process_name", "parent_process", "file_path", "src_ip", "dst_ip"]
    if "ocsf" in events.columns:
        rows = with_document(events, columns)
    else:
        rows = events.select(*columns, F.from_json(F.lit(None).cast("string"), DOCUMENT).alias("o"))
    rows = pinned(rows, {
        "_h": host_key(first_filled("host", "o.device.hostname", "o.unmapped.Hostname")),
        "_u": user_key(first_filled("user_name", "o.actor.user.name", "o.unmapped.User", "o.unmapped.SubjectUserName")),
        "_p": windows_path(first_filled("process_name", "o.process.file.path", "o.unmapped.Image", "o.unmapped.NewProcessName")),
        "_pp": windows_path(first_filled("parent_process", "o.process.parent_process.file.path", "o.unmapped.ParentImage")),
        "_f": windows_path(first_filled("file_path", "o.file.path", "o.unmapped.TargetFilename")),
        "_d": routable_ip(first_filled("dst_ip", "o.dst_endpoint.ip")),
        "_s": routable_ip(first_filled("src_ip", "o.src_endpoint.ip")),
    })

    def thing(kind: str, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))

    things = {"_h": "host", "_u": "user", "_p": "process", "_pp": "process", "_f": "file", "_d": "ip", "_s": "ip"}
    links = [
        ("_u", "_p", "executed", None),
        ("_pp", "_p", "spawned", F.col("_pp") != F.col("_p")),
        ("_p", "_f", "wrote", F.col("_p") != F.col("_f")),
        ("_p", "_d", "connected_to", None),
        ("_h", "_u", "authenticated_as", ~is_machine_account(F.col("_u"))),
    ]

    def link(a: str, b: str, name: str, fits: Column | None) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        row = F.struct(F.lit(things[a]).alias("src_kind"), F.col(a).alias("src_value"), F.lit(things[b]).alias("dst_kind"), F.col(b).alias("dst_value"), F.lit(name).alias("relation"))
        return F.when(both if fits is None else both & fits, row)

    return rows.select(
        group, "id", "ts",
        F.filter(F.array(*(thing(kind, c) for c, kind in things.items())), lambda x: x.isNotNull()).alias("things"),
        F.filter(F.array(*(link(*x) for x in links)), lambda x: x.isNotNull()).alias("links"),
    )


def entity_id(group: Column, kind: Column, value: Column) -> Column:
    """The identifier of a thing in a group: a hash of what it is, so that it needs no table to look it up in."""
    return F.sha2(F.concat_ws("|", group.cast("string"), kind, value), 256)


def entities(events: DataFrame, group: str) -> DataFrame:
    """Per group and thing: entity_id, first_seen, last_seen, n_events and the least event id.

    Event ids stay in the pair table `entity_events`: a thing may occur in a third of all events, which
    no single row should hold.
    """
    rows = named_things(events, group).select(group, "id", "ts", F.explode(F.array_distinct("things")).alias("t"))
    out = rows.groupBy(group, F.col("t.kind").alias("kind"), F.col("t.value").alias("value")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("id").alias("n_events"), F.min("id").alias("first_id")
    )
    return out.withColumn("entity_id", entity_id(F.col(group), F.col("kind"), F.col("value")))


def entity_events(events: DataFrame, group: str) -> DataFrame:
    """The pairs (group, kind, value, id)."""
    rows = named_things(events, group).select(group, "id", F.explode(F.array_distinct("things")).alias("t"))
    return rows.select(group, F.col("t.kind").alias("kind"), F.col("t.value").alias("value"), "id").distinct()


_EDGE = ["src_kind", "src_value", "dst_kind", "dst_value", "relation"]


def entity_edges(events: DataFrame, group: str) -> DataFrame:
    """Per group and link between two things: the entity ids of its ends, n_events and the least event id.

    Event ids stay in the pair table `entity_edge_events`.
    """
    rows = named_things(events, group).select(group, "id", F.explode(F.array_distinct("links")).alias("e")).select(group, "id", "e.*")
    out = rows.groupBy(group, *_EDGE).agg(F.count_distinct("id").alias("n_events"), F.min("id").alias("first_id"))
    ends = {f"{end}_id": entity_id(F.col(group), F.col(f"{end}_kind"), F.col(f"{end}_value")) for end in ("src", "dst")}
    return out.withColumns(ends)


def entity_edge_events(events: DataFrame, group: str) -> DataFrame:
    """The pairs of an edge and an event id: group, the edge's ends and relation, id."""
    rows = named_things(events, group).select(group, "id", F.explode(F.array_distinct("links")).alias("e"))
    return rows.select(group, "e.*", "id").distinct()


def resolved_edges(edges: DataFrame, things: DataFrame, group: str) -> DataFrame:
    """Edges whose two ends are entities of the same group, with those entities' ids: two joins, both ends required."""
    for end in ("src", "dst"):
        known = things.select(group, F.col("kind").alias(f"{end}_kind"), F.col("value").alias(f"{end}_value"), F.col("entity_id").alias(f"{end}_id"))
        edges = edges.drop(f"{end}_id").join(known, [group, f"{end}_kind", f"{end}_value"])
    return edges


#: Events meet the span of an incident by hours, so a key that all events share is spread over time.
CELL_US = 3_600_000_000


def evidence(fields: DataFrame, alerting: DataFrame, group: str, cap: int = EVIDENCE_CAP, user_cap: int = USER_CAP) -> DataFrame:
    """(group, id, tier) of the events that support each incident, within a budget.

    Tier 0: the alerting events, never cut. Tier 1: events that name an alerting event's process, from
    60 s before the incident's span to 60 s after. Tier 2: events of an alerting host and telling user
    within 30 s of the span, without handle churn, at most user_cap of each host and user. Tier 3: events
    whose parent is an alerting process. From tier 1 on, what exceeds cap in the order (tier, ts, id) is cut.

    fields: columns of event_fields, written down before, as four joins read them; alerting: event_id and
    group, in any number of rows. Process, host and user of an incident are those of its alerting events.
    Candidates meet events on equal keys and equal hours, the span as residual; the limits are window
    limits that apply before the shuffle too.
    """
    at = F.unix_micros("ts")
    ev = fields.select("id", at.alias("at"), F.floor(at / F.lit(CELL_US)).alias("cell"), F.col("host_key").alias("host"), "user_norm", "own_uid", "uids", "parent_uids", "code")
    pairs = alerting.select(group, F.col("event_id").alias("id")).where(F.col(group).isNotNull() & F.col("id").isNotNull()).distinct()
    zero = write_read(pairs.join(ev.select("id", "at", "host", "user_norm", "own_uid"), "id"), "alerting")
    span = zero.groupBy(group).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))

    def around(keys: DataFrame, pad_s: int) -> DataFrame:
        lo, hi = F.col("lo") - pad_s * 1_000_000, F.col("hi") + pad_s * 1_000_000
        rows = keys.join(span, group).withColumns({"lo": lo, "hi": hi})
        return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(CELL_US)), F.floor(F.col("hi") / F.lit(CELL_US)))))

    inside = (F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))
    uids = zero.where("own_uid is not null").select(group, F.col("own_uid").alias("uid")).distinct()
    named = ev.select("id", "at", "cell", F.explode("uids").alias("uid"))
    one = around(uids, PROCESS_PAD_S).join(named, ["uid", "cell"]).where(inside).withColumn("tier", F.lit(1))
    users = zero.where(F.col("host").isNotNull() & is_correlating_user(F.col("user_norm"))).select(group, "host", "user_norm").distinct()
    two = around(users, USER_PAD_S).join(ev.where(~F.col("code").isin(*HANDLE_CODES)).select("id", "at", "cell", "host", "user_norm"), ["host", "user_norm", "cell"]).where(inside)
    first = Window.partitionBy(group, "host", "user_norm").orderBy("at", "id")
    two = two.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= user_cap).withColumn("tier", F.lit(2))
    three = uids.join(ev.select("id", "at", F.explode("parent_uids").alias("uid")), "uid").withColumn("tier", F.lit(3))
    cols = [group, "id", "at", "tier"]
    found = zero.select(group, "id", "at").withColumn("tier", F.lit(0)).unionByName(one.select(cols)).unionByName(two.select(cols)).unionByName(three.select(cols))
    best = found.groupBy(group, "id").agg(F.min("tier").alias("tier"), F.min("at").alias("at"))
    rest = best.where("tier > 0").withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("tier", "at", "id")))
    used = zero.groupBy(group).agg(F.count(F.lit(1)).alias("_used"))
    kept = rest.where(F.col("_n") <= cap).join(used, group).where(F.col("_n") <= cap - F.col("_used"))
    return zero.select(group, "id").withColumn("tier", F.lit(0)).unionByName(kept.select(group, "id", "tier"))
