"""Queries of the general problems (p1 to p5) over the telemetry and feed tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.keys import code_key, host_key, one_per_record, user_key
from siltstone.operators.eager import eager_join_aggregate, longest_gap_by_key
from siltstone.operators.features import entity_features, features_long
from siltstone.operators.sessions import SessionTable, split_batches
from siltstone.operators.shred import entity_table, node_paths, object_nodes, scalar_values, stored_adjacency
from siltstone.operators.timestamps import clock_zone, normalise
from siltstone.session import scratch_path, spread, table, write_read

SESSION_GAP_US = 1_800_000_000


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_adjacency(spread(table(spark, sf_dir, "telemetry").select("id", "ocsf", "raw")), "id", ["ocsf", "raw"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_nodes(node_paths(_nodes(spark, sf_dir), "id")).select("id", "doc", "node_path", "parent_path")


def _entities(spark: SparkSession, sf_dir: str, label: str, attributes: list[str]) -> DataFrame:
    return entity_table(_nodes(spark, sf_dir), "id", label, attributes)


def p1_process_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, "process", ["pid", "uid", "name", "cmd_line"])


def p1_parent_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, "parent_process", ["pid", "uid", "name"])


def p1_file_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, "file", ["path", "name"])


def p1_user_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, "user", ["name", "domain", "uid"])


def p1_array_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars in arrays of the records, as a child table."""
    return scalar_values(_nodes(spark, sf_dir), "id")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with a host and a code, one row per source record (the first delivery that has both)."""
    rows = table(spark, sf_dir, "telemetry").select(
        "uid", "ingested_at", "id", host_key(F.col("host")).alias("host"), code_key(F.col("event_code")).alias("event_code"), F.unix_micros("ts").alias("at_us")
    )
    return one_per_record(rows.where(F.col("host").isNotNull() & F.col("event_code").isNotNull() & F.col("at_us").isNotNull()), "uid", "ingested_at", "id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_gap_by_key(_keyed(spark, sf_dir), ["host", "event_code"], "at_us", tie="uid")


def p2_alert_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event code: pairs of an event and an alert of its host, and the severity those alerts sum to."""
    graded = {"low": 1, "medium": 2, "high": 3, "critical": 4}
    grade = F.create_map(*(F.lit(x) for kv in graded.items() for x in kv))[F.col("severity")].cast("bigint")
    alerts = table(spark, sf_dir, "alerts").select(host_key(F.col("host")).alias("host"), "severity")
    out = eager_join_aggregate(_keyed(spark, sf_dir), alerts, ["host"], ["event_code"], right_sums={"severity_sum": grade})
    return out.select("event_code", F.col("n_pairs").cast("bigint").alias("n_pairs"), F.col("severity_sum").cast("bigint").alias("severity_sum"))


#: Entities of one bucket of the feature tables.
BUCKET_ENTITIES = 2_000


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All hosts and the latest time in one scan; rows without a host have a say in the time only.
    rows = table(spark, sf_dir, "telemetry").select(host_key(F.col("host")).alias("host"), F.unix_micros("ts").alias("at_us"))
    hosts = write_read(rows.groupBy("host").agg(F.max("at_us").alias("at_us")), "hosts")
    sizes = hosts.agg(F.max("at_us").alias("latest"), F.count(F.lit(1)).alias("hosts")).first()
    buckets = min(math.ceil((sizes["hosts"] + 1) / BUCKET_ENTITIES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return entity_features(_keyed(spark, sf_dir), "host", "event_code", "at_us", sizes["latest"], entities=hosts, buckets=buckets)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = features_long(_features(spark, sf_dir), "host", "event_code")
    return long.select("host", "event_code", F.col("n").alias("n_events"), F.col("n_recent").alias("n_last_day"), "idle_us", F.col("total").alias("host_total"))


def p3_host_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature rows as they are stored, one per host, the block maps as JSON."""
    rows = _features(spark, sf_dir)
    blocks = [c for c in rows.columns if c.startswith("block_")]
    return rows.select("host", F.col("total").alias("host_total"), "n_types", "last_us", *(F.to_json(c).alias(c) for c in blocks))


def p3_host_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar features of every host, those without a coded event too."""
    return _features(spark, sf_dir).select("host", F.col("total").alias("host_total"), "n_types", "last_us")


def p4_found(spark: SparkSession, sf_dir: str, n_batches: int = 3) -> DataFrame:
    events = table(spark, sf_dir, "telemetry").select(
        "uid", "ingested_at", "id", host_key(F.col("host")).alias("host"), user_key(F.col("user_name")).alias("user_name"), F.unix_micros("ts").alias("at_us")
    )
    events = events.where(F.col("host").isNotNull() & F.col("user_name").isNotNull() & F.col("at_us").isNotNull())
    sessions = SessionTable(spark, scratch_path(spark, "sessions"), ["host", "user_name"], "at_us", SESSION_GAP_US, "uid", ("ingested_at", "id"))
    for batch in split_batches(events, "ingested_at", n_batches, table(spark, sf_dir, "telemetry")):
        sessions.apply(batch)
    return sessions.read().select("host", "user_name", "start_us", "end_us", "n_events")


def p4_session_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By host: sessions, events in them, mean (whole microseconds) and longest duration."""
    length = F.col("end_us") - F.col("start_us")
    out = p4_found(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum(length).alias("_all"), F.max(length).alias("longest_us"))
    return out.select("host", "n_sessions", "n_events", F.expr("_all div n_sessions").alias("mean_us"), "longest_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = table(spark, sf_dir, "datasets").select("dataset", clock_zone(F.col("event_time_offset")).alias("clock"), "date_order")
    lines = spread(table(spark, sf_dir, "feed_records").select("record_id", "dataset", "time_field", "ts", "received_at")).join(clocks, "dataset", "left")
    zone = F.when(F.col("time_field") == "UtcTime", "+00:00").when(F.col("time_field") == "EventTime", F.col("clock"))
    found = normalise(lines, "ts", zone, F.col("date_order"), F.col("received_at"))
    return found.where(F.col("ts_us").isNotNull()).select("record_id", "ts_us")


_HOST = r"nullif(nullif(upper(trim(split_part(trim({c}), '.', 1))), ''), '-')"
_USER = r"nullif(nullif(trim(lower(regexp_replace(trim(user_name), '^(quillmere\.example|quillmere)\\|@(quillmere\.example|quillmere)$', '', 'i'))), ''), '-')"
_KEYED = f"""keyed as (
  select host, event_code, epoch_us(ts) at_us from (
    select *, row_number() over (partition by uid order by ingested_at, id) rn from (
      select uid, ingested_at, id, ts, {_HOST.format(c="host")} host, nullif(nullif(trim(event_code), ''), '-') event_code from telemetry)
    where host is not null and event_code is not null and ts is not null)
  where rn = 1)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_process_entities": p1_process_entities,
    "p1_parent_entities": p1_parent_entities,
    "p1_file_entities": p1_file_entities,
    "p1_user_entities": p1_user_entities,
    "p1_array_values": p1_array_values,
    "p2_found": p2_found,
    "p2_alert_pressure": p2_alert_pressure,
    "p3_found": p3_found,
    "p3_host_rows": p3_host_rows,
    "p3_host_totals": p3_host_totals,
    "p4_found": p4_found,
    "p4_session_lengths": p4_session_lengths,
    "p5_found": p5_found,
}

_SESSIONS = f"""sessions as (
  select host, user_name, min(at_us) start_us, max(at_us) end_us, count(*)::bigint n_events from (
    select *, sum(new) over (partition by host, user_name order by at_us rows unbounded preceding) no from (
      select *, case when at_us - lag(at_us) over (partition by host, user_name order by at_us) <= {SESSION_GAP_US} then 0 else 1 end new from (
        select host, user_name, epoch_us(ts) at_us from (
          select *, row_number() over (partition by uid order by ingested_at, id) rn from (
            select uid, ingested_at, id, ts, {_HOST.format(c="host")} host, {_USER} user_name from telemetry)
          where host is not null and user_name is not null and ts is not null) where rn = 1)))
  group by host, user_name, no)"""

_DOC = "case when json_valid({c}) then case when json_type({c}::json) = 'VARCHAR' then json_extract_string({c}::json, '$') else {c} end end"
_WALK = f"""with recursive docs as (select id, doc, v from (
  select id, 'ocsf' doc, {_DOC.format(c="ocsf")} v from telemetry union all select id, 'raw', {_DOC.format(c="raw")} from telemetry) where json_valid(v) and json_type(v::json) in ('OBJECT', 'ARRAY')),
walk(id, doc, v, path, near, label, ordinal) as (
  select id, doc, v::json, '', '/', null::varchar, null::bigint from docs
  union all
  select w.id, w.doc, e.value, w.path || '/' || e.key, case when json_type(w.v) = 'OBJECT' then case when w.path = '' then '/' else w.path end else w.near end,
    case when json_type(w.v) = 'OBJECT' then e.key else w.label end, case when json_type(w.v) = 'ARRAY' then e.key::bigint end
  from walk w, json_each(w.v) e where e.type in ('OBJECT', 'ARRAY'))"""
_SCALAR = "case when json_type(v, '$.{a}') not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string(v, '$.{a}') end a_{a}"


# The clocks of the test tables only; their offsets are tried out, not looked up.
_STAMPS = r"""with lines as (
  select l.record_id, l.time_field, l.received_at, epoch_us(l.received_at) rec, d.date_order ord,
    replace(regexp_replace(l.ts, '^\s+|\s+$', '', 'g'), chr(8722), '-') t,
    case when l.time_field = 'UtcTime' then '+00:00' when l.time_field = 'EventTime' then case
      when regexp_matches(d.event_time_offset, '^[+-]\d{2}:\d{2}$') then d.event_time_offset
      when regexp_matches(d.event_time_offset, '^[+-]\d{4}$') then substr(d.event_time_offset, 1, 3) || ':' || substr(d.event_time_offset, 4)
      when regexp_matches(d.event_time_offset, '^UTC[+-]\d{2}:\d{2}$') then substr(d.event_time_offset, 4)
      when d.event_time_offset = 'UTC' then '+00:00'
      when regexp_matches(d.event_time_offset, '^-PT\d+H$') then '-' || lpad(regexp_extract(d.event_time_offset, '(\d+)', 1), 2, '0') || ':00'
      when regexp_matches(d.event_time_offset, '^-1 day, \d{2}:00:00$') then '-' || lpad((24 - regexp_extract(d.event_time_offset, ', (\d{2})', 1)::int)::varchar, 2, '0') || ':00'
      when regexp_matches(d.event_time_offset, '^\d+$') then '+' || lpad((d.event_time_offset::int // 3600)::varchar, 2, '0') || ':' || lpad((d.event_time_offset::int // 60 % 60)::varchar, 2, '0')
      else d.event_time_offset end end clock
  from feed_records l left join datasets d on l.dataset = d.dataset),
parsed as (
  select *, upper(t) u, '(?: ?(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,4}))?$' zone_end from lines),
fields as (
  select *, case
    when regexp_matches(u, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?' || zone_end) then struct_pack(dt := substr(u, 1, 10), tm := rpad(substr(u, 12, 5) || coalesce(nullif(regexp_extract(u, '^.{16}(:\d{2})', 1), ''), ':00'), 8, '0'), rest := regexp_replace(substr(u, 17), '^:\d{2}', ''), year_given := true, half := '')
    when regexp_matches(u, '^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}([.,]\d{1,9})?' || zone_end) then struct_pack(dt := substr(u, 7, 4) || '-' || substr(u, 4, 2) || '-' || substr(u, 1, 2), tm := substr(u, 12, 8), rest := substr(u, 20), year_given := true, half := '')
    when regexp_matches(u, '^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}( [AP]M)?$') and ord is not null then struct_pack(
      dt := substr(u, 7, 4) || '-' || case when ord = 'mdy' then substr(u, 1, 2) || '-' || substr(u, 4, 2) else substr(u, 4, 2) || '-' || substr(u, 1, 2) end, tm := substr(u, 12, 8), rest := '', year_given := true, half := regexp_extract(u, ' ([AP]M)$', 1))
    when regexp_matches(u, '^\d{2}/[A-Z]{3}/\d{4}:\d{2}:\d{2}:\d{2}' || zone_end) then struct_pack(dt := strftime(try_strptime(substr(u, 1, 11), '%d/%b/%Y'), '%Y-%m-%d'), tm := substr(u, 13, 8), rest := substr(u, 21), year_given := true, half := '')
    when regexp_matches(u, '^[A-Z]{3}, \d{1,2} [A-Z]{3} \d{4} \d{2}:\d{2}:\d{2}' || zone_end) then struct_pack(
      dt := case when upper(strftime(try_strptime(regexp_extract(u, ', (\d{1,2} [A-Z]{3} \d{4})', 1), '%d %b %Y'), '%a')) = substr(u, 1, 3) then strftime(try_strptime(regexp_extract(u, ', (\d{1,2} [A-Z]{3} \d{4})', 1), '%d %b %Y'), '%Y-%m-%d') end,
      tm := regexp_extract(u, ' (\d{2}:\d{2}:\d{2})', 1), rest := regexp_extract(u, ' \d{2}:\d{2}:\d{2}(.*)$', 1), year_given := true, half := '')
    when regexp_matches(u, '^\d{8}T\d{6}' || zone_end) then struct_pack(dt := substr(u, 1, 4) || '-' || substr(u, 5, 2) || '-' || substr(u, 7, 2), tm := substr(u, 10, 2) || ':' || substr(u, 12, 2) || ':' || substr(u, 14, 2), rest := substr(u, 16), year_given := true, half := '')
    when regexp_matches(u, '^\d{14}\.\d{6}[+-]\d{3}$') then struct_pack(dt := substr(u, 1, 4) || '-' || substr(u, 5, 2) || '-' || substr(u, 7, 2), tm := substr(u, 9, 2) || ':' || substr(u, 11, 2) || ':' || substr(u, 13, 2), rest := substr(u, 15, 7) || substr(u, 22, 1) || lpad((substr(u, 23, 3)::int // 60)::varchar, 2, '0') || lpad((substr(u, 23, 3)::int % 60)::varchar, 2, '0'), year_given := true, half := '')
    when regexp_matches(u, '^[A-Z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}$') then struct_pack(dt := lpad(((position(substr(u, 1, 3) in 'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC') + 2) // 3)::varchar, 2, '0') || '-' || lpad(regexp_extract(u, '^[A-Z]{3} +(\d{1,2})', 1), 2, '0'), tm := regexp_extract(u, '(\d{2}:\d{2}:\d{2})$', 1), rest := '', year_given := false, half := '')
    end f from parsed),
dated as (
  select record_id, rec, clock, u, f.rest rest, k, case when hour(received_at) >= 0 then try_cast(case when f.year_given then f.dt else (year(received_at) + 1 - k)::varchar || '-' || f.dt end || ' ' || case
      when f.half = '' then f.tm when substr(f.tm, 1, 2)::int not between 1 and 12 then null else lpad((substr(f.tm, 1, 2)::int % 12 + case when f.half = 'PM' then 12 else 0 end)::varchar, 2, '0') || substr(f.tm, 3) end as timestamp) end wall
  from fields, range(0, 10) r(k) where f is not null and (not f.year_given or k = 0) and not regexp_matches(f.tm, ':60$')),
timed as (
  select *, epoch_us(wall) + coalesce(try_cast(rpad(substr(regexp_extract(rest, '^[.,](\d{1,9})', 1), 1, 6), 6, '0') as bigint), 0) wall_us, nullif(trim(regexp_replace(rest, '^[.,]\d{1,9}', '')), '') zone from dated where wall is not null),
offsets as (
  select *, case when zone is null then null when zone in ('Z', 'UTC', 'GMT') then 0 when zone = 'EDT' then -240 when zone = 'EST' then -300 when zone = 'CET' then 60 when zone = 'CEST' then 120 when zone = 'AEST' then 600 when zone = 'AEDT' then 660
    when regexp_matches(zone, '^[+-]') then (case when zone[1] = '-' then -1 else 1 end) * (substr(zone, 2, 2)::int * 60 + right(zone, 2)::int) end given,
    case when regexp_matches(clock, '^[+-]') then (case when clock[1] = '-' then -1 else 1 end) * (substr(clock, 2, 2)::int * 60 + right(clock, 2)::int) end fixed from timed),
instants as (
  select record_id, rec, k, wall_us - coalesce(given, fixed)::bigint * 60000000 inst from offsets where given is not null or (zone is null and fixed is not null)
  union all
  select record_id, rec, k, wall_us - o::bigint * 60000000 from offsets, unnest([-300, -240, 60, 120, 600, 660]) z(o)
  where zone is null and fixed is null and clock is not null and epoch_us(timezone(clock, make_timestamptz(wall_us - o::bigint * 60000000))) = wall_us),
reached as (select *, count(*) over (partition by record_id, k) readings, min(inst) over (partition by record_id, k) earliest from instants),
chosen as (select *, min(k) filter (earliest <= rec) over (partition by record_id) year_back from reached),
numbers as (
  select record_id, rec, case when regexp_matches(u, '^\d{10}$') then u::bigint * 1000000 when regexp_matches(u, '^\d{10}\.\d{1,6}$') then substr(u, 1, 10)::bigint * 1000000 + rpad(substr(u, 12), 6, '0')::bigint
    when regexp_matches(u, '^\d{13}$') then u::bigint * 1000 when regexp_matches(u, '^\d{16}$') then u::bigint when regexp_matches(u, '^1\d{17}$') then u::bigint // 10 - 11644473600000000 end inst from parsed)
select record_id, inst::bigint ts_us from chosen where k = year_back and inst <= rec and (readings = 1 or rec - inst < 3600000000)
union all
select record_id, inst::bigint from numbers where inst <= rec"""


def _entity_sql(label: str, attributes: list[str]) -> str:
    return f"""{_WALK} select id, doc, path node_path, near parent_path, ordinal, {", ".join(_SCALAR.format(a=a) for a in attributes)}
from walk where json_type(v) = 'OBJECT' and path <> '' and label = '{label}'"""


ORACLES = {
    "p1_found": f"{_WALK} select id, doc, path node_path, near parent_path from walk where json_type(v) = 'OBJECT' and path <> ''",
    "p1_process_entities": _entity_sql("process", ["pid", "uid", "name", "cmd_line"]),
    "p1_parent_entities": _entity_sql("parent_process", ["pid", "uid", "name"]),
    "p1_file_entities": _entity_sql("file", ["path", "name"]),
    "p1_user_entities": _entity_sql("user", ["name", "domain", "uid"]),
    "p1_array_values": f"""{_WALK} select w.id, w.doc, case when w.path = '' then '/' else w.near end parent_path, w.label, e.key::bigint ordinal, json_extract_string(e.value, '$') scalar
from walk w, json_each(w.v) e where json_type(w.v) = 'ARRAY' and e.type not in ('OBJECT', 'ARRAY', 'NULL')""",
    "p2_found": f"""with {_KEYED}
select host, event_code, count(*)::bigint n_events, coalesce(max(gap), 0)::bigint max_gap_us from (
  select *, at_us - lag(at_us) over (partition by host, event_code order by at_us) gap from keyed)
group by host, event_code""",
    "p2_alert_pressure": f"""with {_KEYED}
select event_code, count(*)::bigint n_pairs, sum(case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end)::bigint severity_sum
from keyed join (select {_HOST.format(c="host")} host, severity from alerts) a using (host) group by event_code""",
    "p3_found": f"""with {_KEYED}, latest as (select max(epoch_us(ts)) l from telemetry)
select host, event_code, count(*)::bigint n_events, count(*) filter (where at_us >= l - 86400000000)::bigint n_last_day,
  (max(l) - max(at_us))::bigint idle_us, (sum(count(*)) over (partition by host))::bigint host_total
from keyed, latest group by host, event_code""",
    "p3_host_totals": f"""with {_KEYED}, hosts as (select distinct {_HOST.format(c="host")} host from telemetry)
select h.host, count(k.host)::bigint host_total, count(distinct k.event_code)::bigint n_types, max(k.at_us)::bigint last_us from hosts h left join keyed k using (host) where h.host is not null group by h.host""",
    "p5_found": _STAMPS,
    "p4_found": f"with {_SESSIONS} select * from sessions",
    "p4_session_lengths": f"""with {_SESSIONS}
select host, count(*)::bigint n_sessions, sum(n_events)::bigint n_events, (sum(end_us - start_us) // count(*))::bigint mean_us, max(end_us - start_us)::bigint longest_us
from sessions group by host""",
}
