"""Queries of the reference operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from siltstone.functions import minhash, parse
from siltstone.functions.event_text import event_line
from siltstone.functions.keys import host_key, user_key
from siltstone.functions.normalize import is_correlating_user, is_machine_account, process_uid, routable_ip, windows_path
from siltstone.operators import accuracy, audit, beacon, correlate, dedup, incident, rules, search, upsert, validate
from siltstone.operators.numbering import numbered
from siltstone.operators.timestamps import pinned
from siltstone.plans import pipeline
from siltstone.session import spread, table, write_read
from siltstone.sources.records import parse_records, reject_counts, with_record

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _host(c: str) -> str:
    return rf"nullif(nullif(upper(trim(split_part(trim({c}), '.', 1))), ''), '-')"


def _user(c: str) -> str:
    return rf"nullif(nullif(trim(lower(regexp_replace(trim({c}), '^(quillmere\.example|quillmere)\\|@(quillmere\.example|quillmere)$', '', 'i'))), ''), '-')"


def _uid(c: str) -> str:
    return rf"nullif(nullif(upper(trim(regexp_replace(trim({c}), '^\{{+|\}}+$', '', 'g'))), ''), '-')"


def _path(c: str) -> str:
    return rf"nullif(nullif(regexp_replace(lower(trim({c})), '^\\device\\harddiskvolume[0-9]+\\', 'c:\\'), ''), '-')"


_V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def _ip(c: str) -> str:
    bare = rf"regexp_replace(trim({c}), '^::ffff:', '', 'i')"
    return rf"case when regexp_matches({bare}, '{_V4}') and not regexp_matches({bare}, '^(127|22[4-9]|23[0-9])\.|^169\.254\.') and {bare} not in ('0.0.0.0', '255.255.255.255') then {bare} end"


# --- detection ----------------------------------------------------------------------------------

_J = "json_extract_string"


def _f(*parts: str) -> str:
    """The first non-empty of columns and document paths."""
    return "coalesce(" + ", ".join(f"nullif({_J}(o, '{p}'), '')" if p.startswith("$") else f"nullif({p}, '')" for p in parts) + ")"


_DOC = "case when json_valid(ocsf) then case when json_type(ocsf::json) = 'VARCHAR' then json_extract_string(ocsf::json, '$') else ocsf end end"
_HAS = "coalesce({j}(o, '{p}.pid'), {j}(o, '{p}.uid'), {j}(o, '{p}.cmd_line'), {j}(o, '{p}.file')) is not null"
_OWN = _HAS.format(j=_J, p="$.process")
_OWN_PARENT = _HAS.format(j=_J, p="$.process.parent_process")
_ACT_PARENT = _HAS.format(j=_J, p="$.actor.process.parent_process")


def _proc(member: str) -> str:
    return f"case when {_OWN} then {_J}(o, '$.process.{member}') else {_J}(o, '$.actor.process.{member}') end"


def _parent(member: str) -> str:
    own = f"case when {_OWN} then {_OWN_PARENT} else {_ACT_PARENT} end"
    mine = f"case when {_OWN} then {_J}(o, '$.process.parent_process.{member}') else {_J}(o, '$.actor.process.parent_process.{member}') end"
    return f"case when {own} then {mine} else {_J}(o, '$.actor.process.parent_process.{member}') end"


def _leaf(c: str) -> str:
    return rf"coalesce(regexp_extract({c}, '([^\\]*)$', 1), '')"


_FIELDS = f"""docs as (select *, {_DOC} o from telemetry),
raws as (select id, {_DOC.replace('ocsf', 'raw')} r from telemetry),
f0 as (
  select docs.id, ts, incident_id, coalesce(event_code, '') code, {_host(_f('host', '$.device.hostname', '$.unmapped.Hostname'))} host,
    {_user(_f('user_name', '$.actor.user.name', '$.user.name', '$.unmapped.User', '$.unmapped.SubjectUserName'))} user_norm,
    {_uid(f"coalesce(nullif({_proc('uid')}, ''), {_f('$.unmapped.ProcessGuid', '$.unmapped.SourceProcessGUID', '$.unmapped.SourceProcessGuid')})")} process_uid,
    {_uid(_f('$.process.uid', '$.actor.process.uid', '$.unmapped.ProcessGuid', '$.unmapped.SourceProcessGUID', '$.unmapped.SourceProcessGuid'))} own_uid,
    {_uid(_f('$.process.uid'))} u1, {_uid(_f('$.actor.process.uid'))} u2, {_uid(_f('$.unmapped.ProcessGuid'))} u3,
    {_uid(_f('$.process.parent_process.uid'))} q1, {_uid(_f('$.actor.process.parent_process.uid'))} q2, {_uid(_f('$.unmapped.ParentProcessGuid'))} q3,
    {_path(f"coalesce(nullif(process_name, ''), nullif({_proc('file.path')}, ''), {_f('$.unmapped.Image', '$.unmapped.NewProcessName', '$.unmapped.ProcessName')})")} process_path,
    {_path(f"coalesce(nullif(parent_process, ''), nullif({_parent('file.path')}, ''), {_f('$.unmapped.ParentImage', '$.unmapped.ParentProcessName')})")} parent_path,
    coalesce(nullif(command_line, ''), nullif({_proc('cmd_line')}, ''), {_f('$.unmapped.CommandLine')}, '') command,
    {_path(_f('file_path', '$.file.path', '$.unmapped.TargetFilename'))} file_path,
    {_path(f"coalesce(nullif({_proc('file.path')}, ''), {_f('$.unmapped.TargetImage')})")} target_path,
    {_path(f"coalesce(nullif({_parent('file.path')}, ''), {_f('$.unmapped.SourceImage')})")} source_path,
    lower({_J}(o, '$.unmapped.GrantedAccess')) access,
    {_path(_f('$.reg_key.path', '$.reg_value.path', '$.unmapped.TargetObject', '$.unmapped.ObjectName'))} registry_path,
    {_path(_f('$.module.file.path', '$.unmapped.ImageLoaded'))} module_path,
    lower(coalesce({_f('$.unmapped.TaskName')}, nullif({_J}(r, '$.TaskName'), ''))) task,
    upper({_J}(o, '$.unmapped.ShareName')) share,
    coalesce({_f('$.unmapped.LogonType')}, nullif({_J}(r, '$.LogonType'), '')) logon_type,
    lower({_J}(o, '$.unmapped.TicketEncryptionType')) ticket,
    {_ip(_f('src_ip', '$.src_endpoint.ip'))} src_peer, {_ip(_f('dst_ip', '$.dst_endpoint.ip'))} dst_peer,
    {_ip(f"nullif(regexp_extract({_J}(r, '$.Message'), 'Source Network Address:[[:space:]]*([^[:space:]]+)', 1), '')")} rdp_peer,
    try_cast({_f('$.dst_endpoint.port', '$.unmapped.DestinationPort')} as int) dst_port,
    {_J}(o, '$.unmapped.ScriptBlockText') block
  from docs join raws using (id)),
f as (select *, {_leaf('process_path')} process, {_leaf('parent_path')} parent, {_leaf('source_path')} source_name, concat_ws(' ', command, block) script,
  coalesce(process_path, '') || ' ' || coalesce(file_path, '') || ' ' || command shown from f0)"""

_SHELL = r"(powershell|cmd|wscript|cscript|rundll32|mshta|certutil)\.exe$"
_DROP = r"c:\\programdata\\|\\appdata\\local\\temp\\|c:\\users\\[^\\]+\\temp\\"
_STAGE = r"\\appdata\\local\\temp\\|c:\\programdata\\|\\appdata\\roaming\\|\\users\\[^\\]+\\documents\\|\\windows\\temp\\"
_START = "code in ('1', '4688')"
_PS = "code in ('1', '4688', '4104') and (contains(process, 'powershell') or code = '4104' or contains(lower(command), 'powershell'))"
_CONDITIONS = {
    "CUR-001": rf"{_START} and regexp_matches(parent, '(winword|excel|powerpnt|outlook)\.exe$') and regexp_matches(process, '{_SHELL}')",
    "CUR-002": rf"{_START} and regexp_matches(process_path, '{_DROP}') and regexp_matches(process, '\.(exe|scr|bat|ps1|vbs)$') and not regexp_matches(process, '^(docker|msedge)')",
    "CUR-003": rf"{_PS} and (regexp_matches(script, '(?i)-enc|-encodedcommand|-e\s|frombase64string') or regexp_matches(script, '(?i)(-w|-windowstyle)\s+hidden'))",
    "CUR-004": rf"{_PS} and regexp_matches(script, '(?i)downloadstring|downloadfile|webrequest|net\.webclient|invoke-webrequest|iwr\s')",
    "CUR-005": "code = '10' and ends_with(target_path, 'lsass.exe') and source_name not in ('csrss.exe', 'wininit.exe') and (access in ('0x1010','0x1038','0x1410','0x1438','0x143a','0x1fffff','0x1f0fff','0x1f3fff') or contains(access, '0x1010'))",
    "CUR-006": r"code in ('12', '13', '4657') and regexp_matches(registry_path, '\\currentversion\\run(once)?')",
    "CUR-007": "code in ('4697', '7045')",
    "CUR-008": r"code in ('4698', '4702') and not regexp_matches(coalesce(task, ''), '\\onedrive standalone update task|\\microsoft\\windows\\(updateorchestrator|softwareprotectionplatform|grouppolicy|device information|application experience|pushtoinstall)')",
    "CUR-009": "code in ('4720', '4722', '4724')",
    "CUR-010": "code in ('4728', '4732')",
    "CUR-011": "code in ('5857', '5858', '5861')",
    "CUR-011 b": f"{_START} and parent = 'wmiprvse.exe'",
    "CUR-012": r"code in ('5140', '5145') and regexp_matches(share, 'ADMIN\$|C\$|IPC\$')",
    "CUR-013": "code = '3' and dst_peer is not null and coalesce(dst_port, 0) not in (53, 88, 135, 389, 445) and process in ('powershell.exe','cmd.exe','rundll32.exe','cscript.exe','wscript.exe','certutil.exe','mshta.exe')",
    "CUR-014": r"code = '11' and contains(file_path, '\startup\')",
    "CUR-015": f"{_START} and process in ('whoami.exe','nltest.exe','systeminfo.exe','net.exe','net1.exe','tasklist.exe','quser.exe','qwinsta.exe','ipconfig.exe')",
    "CUR-016": f"code = '7' and regexp_matches(module_path, '{_DROP}')",
    "CUR-017": "(code = '1149' and rdp_peer <> '172.18.39.2') or (code = '4624' and logon_type = '10' and src_peer <> '172.18.39.2')",
    "CUR-018": "code = '4769' and ticket in ('0x17', '23')",
    "CUR-019": "contains(shown, '\u00e2\u20ac\u00ae') or contains(shown, '.3aka3.') or contains(lower(shown), '.scr')",
    "CUR-020": f"{_START} and process in ('wscript.exe','cscript.exe','mshta.exe','regsvr32.exe') and length(trim(command)) > length(process) + 4",
    "CUR-021": f"{_START} and process = 'wsmprovhost.exe'",
    "CUR-021 b": "code = '3' and dst_port in (5985, 5986) and dst_peer is not null",
    "CUR-022": rf"code = '11' and regexp_matches(file_path, '{_STAGE}') and regexp_matches(file_path, '\.(zip|rar|7z|gz|tar|cab)$') and not regexp_matches(file_path, 'c:\\programdata\\microsoft\\windows\\')",
}
# Fixed values, written out again for the SQL: name, grade, tactic and technique hints of each rule.
_SAID = {
    "CUR-001": ("Office Application Spawning Script Interpreter or Shell", "critical", "Execution", "T1059.001,T1204.002"),
    "CUR-002": ("Execution from ProgramData or Temp Directory", "high", "Execution", "T1059,T1204"),
    "CUR-003": ("PowerShell Encoded or Hidden Window Execution", "high", "Execution", "T1059.001,T1027"),
    "CUR-004": ("PowerShell Web Download Cradle Execution", "high", "Command and Control", "T1105,T1059.001"),
    "CUR-005": ("Suspicious LSASS Process Memory Access", "critical", "Credential Access", "T1003.001"),
    "CUR-006": ("Registry Run or RunOnce Key Modification", "high", "Persistence", "T1547.001"),
    "CUR-007": ("Windows Service Installed or Created", "high", "Persistence", "T1543.003,T1569.002"),
    "CUR-008": ("Scheduled Task Created or Updated", "medium", "Persistence", "T1053.005"),
    "CUR-009": ("Local User Account Created or Enabled", "high", "Persistence", "T1136.001"),
    "CUR-010": ("Privileged Security Group Membership Changed", "high", "Persistence", "T1098"),
    "CUR-011": ("WMI Activity Provider Operation", "medium", "Execution", "T1047"),
    "CUR-011 b": ("Process Spawned by WMI Provider (wmiprvse.exe)", "medium", "Execution", "T1047"),
    "CUR-012": ("Administrative Network Share Accessed", "medium", "Lateral Movement", "T1021.002"),
    "CUR-013": ("Scripting Process Initiated Outbound Network Connection", "medium", "Command and Control", "T1071.001"),
    "CUR-014": ("File Created in Startup Folder", "high", "Persistence", "T1547.001"),
    "CUR-015": ("System or Network Discovery Command Executed", "low", "Discovery", "T1033,T1082,T1016,T1049,T1057"),
    "CUR-016": ("Module Loaded from Non-Standard Directory", "medium", "Defense Evasion", "T1574"),
    "CUR-017": ("Remote Desktop Interactive Session Connected", "high", "Lateral Movement", "T1021.001"),
    "CUR-018": ("Kerberos Ticket Request with RC4 Encryption", "high", "Credential Access", "T1558.003"),
    "CUR-019": ("Masqueraded Filename or Right-to-Left Override Extension", "critical", "Defense Evasion", "T1036.002,T1036.005"),
    "CUR-020": ("Suspicious Script Host or Registration Utility Invocation", "medium", "Execution", "T1218,T1059.005"),
    "CUR-021": ("WinRM Remote Management Host Process Spawned", "high", "Lateral Movement", "T1021.006"),
    "CUR-021 b": ("Network Connection to WinRM Port (5985/5986)", "medium", "Lateral Movement", "T1021.006,T1059.001"),
    "CUR-022": ("Archive or Data File Created in Staging Directory", "medium", "Collection", "T1074,T1560"),
}
_SCANNED = "code in ('1','2','3','7','10','11','12','13','23','4688','4624','4697','4698','4702','4720','4722','4724','4728','4732','4769','5140','5145','7045','4104','5857','5858','5861','1149')"
_HITS = "hits as (" + " union all ".join(
    f"select f.*, '{key[:7]}' rule_id, '{name}' rule_name, '{severity}' severity, '{tactic}' tactic, '{techniques}' techniques from f where {_SCANNED} and ({_CONDITIONS[key]})" for key, (name, severity, tactic, techniques) in _SAID.items()
) + ")"
_DETECT = f"with {_FIELDS}, {_HITS}"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "telemetry").where(F.col("event_code").isin(*rules.CANDIDATE_CODES)).select(*rules.EVENT_COLUMNS)
    return rules.detect(spread(scanned))


@query(f"{_DETECT} select id event_id, rule_id, rule_name, severity, tactic, techniques, epoch_us(ts) ts_us, host, user_norm, process_uid, command command_line, file_path, src_peer src_ip, dst_peer dst_ip, dst_port from hits")
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(
        "event_id", "rule_id", "rule_name", "severity", "tactic", F.array_join("technique_ids", ",").alias("techniques"), F.unix_micros("ts").alias("ts_us"),
        "host", "user_norm", "process_uid", "command_line", "file_path", "src_ip", "dst_ip", "dst_port",
    )


@query(f"{_DETECT} select rule_id, severity, count(*)::bigint n from hits group by all")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact step by itself, as the SQL of the queries below has it; the pipeline marks near-duplicates too."""
    return pipeline.exact_alerts(_hits(spark, sf_dir))


_KEYED = (
    "keyed as (select *, row_number() over (order by ts, rule_id, id) alert_id, "
    "sha256(concat_ws('|', rule_id, coalesce(host, ''), coalesce(user_norm, ''), coalesce(process_uid, ''), (epoch_us(ts) // 60000000)::varchar)) dedup_key from hits), "
    "marked as (select *, first_value(alert_id) over (partition by dedup_key order by ts, alert_id) canon from keyed)"
)


@query(f"{_DETECT}, {_KEYED} select alert_id::bigint id, id event_id, rule_id, dedup_key, canon <> alert_id is_duplicate, case when canon <> alert_id then canon::bigint end canonical_id from marked")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("id", "event_id", "rule_id", "dedup_key", "is_duplicate", "canonical_id")


_ALERT_KEY = "sha256(concat_ws('|', coalesce(rule_id, ''), coalesce(host, ''), coalesce(user_norm, ''), coalesce(process_uid, ''), (epoch_us(ts) // 60000000)::varchar))"


@query(f"select dedup_key, count(*)::bigint n, min(id) first_id from (select id, {_ALERT_KEY} dedup_key from alerts) group by 1")
def alert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = dedup.exact_key(F.col("rule_id"), F.col("host"), F.col("user_norm"), F.col("process_uid"), F.col("ts"))
    return table(spark, sf_dir, "alerts").groupBy(key.alias("dedup_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


_TOKENS = r"list_distinct(list_filter(list_transform(regexp_extract_all(command_line, '[a-zA-Z0-9_\-\.:\\]+'), lambda t: lower(t)), lambda t: length(t) > 1))"
_HASH = "(('0x' || substr(md5(t), 7, 2) || substr(md5(t), 5, 2) || substr(md5(t), 3, 2) || substr(md5(t), 1, 2))::bigint)"


_SIGNED_LIST = f"list_transform(range(0, 64), lambda i: coalesce(list_min(list_transform({_TOKENS}, lambda t: ((((i * 10007 + 12345) % 100000 + 1) * {_HASH} + (i * 32452843 + 98765) % 100000 + 1) % 4294967311))), 0))"


@query(f"""with s as (select id, list_transform({_TOKENS}, lambda t: {_HASH}) hs from alerts where command_line is not null),
p as (select i, (i * 10007 + 12345) % 100000 + 1 a, (i * 32452843 + 98765) % 100000 + 1 b from range(0, 64) r(i)),
v as (select id, i, coalesce(list_min(list_transform(hs, lambda h: (a * h + b) % 4294967311)), 0) v from s, p)
select id, string_agg(v::varchar, ',' order by i) signature from v group by id""")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "alerts").where("command_line is not null")
    return rows.select("id", F.array_join(minhash.signature(minhash.tokens(F.col("command_line"))).cast("array<string>"), ",").alias("signature"))


def _greedy_sql(source: str) -> str:
    """CTEs up to `marks` (id, key, owner): the greedy rule in SQL, a step of the recursion for the next alert of every rule, host and user.

    source has id, rule_id, host, user_norm, process_uid, us (microseconds) and command_line.
    """
    return f"""pool as materialized (select *, sha256(concat_ws('|', coalesce(rule_id, ''), coalesce(host, ''), coalesce(user_norm, ''), coalesce(process_uid, ''), (us // 60000000)::varchar)) as key, coalesce({_TOKENS}, []) toks from ({source})),
hashed as (select id, list_transform(toks, lambda t: {_HASH}) hs from pool),
signed as (select id, list(v order by i) sig from (select id, i, coalesce(list_min(list_transform(hs, lambda h: ((((i * 10007 + 12345) % 100000 + 1) * h + (i * 32452843 + 98765) % 100000 + 1) % 4294967311))), 0) v from hashed, range(0, 64) r(i)) group by id),
queue as materialized (select p.id, p.us, p.key, case when len(toks) >= 3 then sig end sig, dense_rank() over (order by rule_id, host, user_norm) g, row_number() over (partition by rule_id, host, user_norm order by us, p.id) k from pool p join signed using (id)),
steps(g, k, id, owner, held) as (
  select distinct g, 0::bigint, null::bigint, null::bigint, []::struct(us bigint, id bigint, key varchar, sig bigint[])[] from queue
  union all
  select g, k, id, owner, list_concat(list_filter(held, lambda h: us - h.us <= 300000000), case when owner is null then [struct_pack(us := us, id := id, key := key, sig := sig)] else [] end) from (
    select q.g, q.k, q.id, q.us, q.key, q.sig, s.held, coalesce(list_filter(s.held, lambda h: h.key = q.key)[1].id,
      list_filter(s.held, lambda h: q.sig is not null and h.sig is not null and q.us - h.us <= 300000000 and list_sum(list_transform(list_zip(h.sig, q.sig), lambda x: (x[1] = x[2])::int)) / 64.0 >= 0.9)[1].id) owner
    from steps s join queue q on q.g = s.g and q.k = s.k + 1)),
marks as materialized (select s.id, q.key, s.owner from steps s join queue q using (id) where s.k > 0)"""


@query(f"with recursive {_greedy_sql('select id, rule_id, host, user_norm, process_uid, epoch_us(ts) us, command_line from alerts')} select id, key dedup_key, owner is not null is_duplicate, owner canonical_id from marks")
def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_greedy(table(spark, sf_dir, "alerts"))


@query("""with s as (select id, rule_id, host, user_norm, epoch_us(ts) us, """ + _SIGNED_LIST + """ sig from alerts where command_line is not null)
select a.id id_a, b.id id_b, round(list_sum(list_transform(list_zip(a.sig, b.sig), lambda x: (x[1] = x[2])::int)) / 64.0, 6) similarity
from s a join s b on a.rule_id = b.rule_id and a.host is not distinct from b.host and a.user_norm is not distinct from b.user_norm and a.id < b.id and abs(a.us - b.us) <= 300000000""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated similarity of the command lines of alerts of one rule, host and user within 300 s of each other."""
    rows = table(spark, sf_dir, "alerts").where("command_line is not null")
    return dedup.similar_pairs(rows).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(f"{_DETECT}, {_KEYED} select alert_id::bigint id, id event_id, canon::bigint canonical_id, first_value(incident_id) over (partition by dedup_key order by ts, alert_id) incident_id from marked")
def attach_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked(spark, sf_dir)
    held = marked.where("not is_duplicate").join(table(spark, sf_dir, "telemetry").select(F.col("id").alias("event_id"), "incident_id"), "event_id", "left")
    held = held.select(F.col("id").alias("canonical_id"), "incident_id")
    return marked.withColumn("canonical_id", F.coalesce("canonical_id", "id")).join(held, "canonical_id").select("id", "event_id", "canonical_id", "incident_id")


# --- beacons ------------------------------------------------------------------------------------


def _beacon_sql(source: str, keys: str, bucket_s: int) -> str:
    return f"""with g as (select {keys}, id, at_us, at_us // {bucket_s}000000 bucket from ({source})),
d as (select *, (at_us - lag(at_us) over (partition by {keys}, bucket order by at_us, id)) / 1e6 gap from g)
select {keys}, bucket::bigint bucket, count(*)::bigint n, min(at_us) first_us, max(at_us) last_us, round(avg(gap), 3) mean_gap, round(stddev_pop(gap), 3) std_gap,
  coalesce(stddev_pop(gap) < avg(gap) * 0.5 + 2, false) is_regular, count(*) >= 10 and coalesce(stddev_pop(gap) < avg(gap) * 0.5 + 2, false) is_beaconing,
  case when (count(*) >= 10 and coalesce(stddev_pop(gap) < avg(gap) * 0.5 + 2, false)) or count(*) >= 20 then 'high' else 'medium' end severity,
  arg_min(id, (at_us, id)) first_id
from d group by {keys}, bucket"""


def _beacons(rows: DataFrame, keys: list[str], id_col: str, bucket_s: int) -> DataFrame:
    out = beacon.beacon_sessions(rows, keys, "ts", id_col, bucket_s)
    return out.withColumns({"mean_gap": F.round("mean_gap", 3), "std_gap": F.round("std_gap", 3)})


_SESSIONS = _beacon_sql("select host, process_uid, dst_peer, dst_port, id, epoch_us(ts) at_us from hits where rule_id = 'CUR-013' and ts is not null", "host, process_uid, dst_peer, dst_port", 300)


@query(f"""{_DETECT}, sessions as ({_SESSIONS})
select rule_id, severity, count(*)::bigint n from (select rule_id, severity from hits where rule_id <> 'CUR-013' or ts is null union all select 'CUR-013', severity from sessions) group by all""")
def pipeline_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by rule as the pipeline raises them: rule_counts counts hits, here connections count by session."""
    return pipeline.found_alerts(_hits(spark, sf_dir)).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_beacon_sql("select event_type, user_id, event_id id, epoch_us(ts) at_us from events", "event_type, user_id", 86400))
def beacon_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beacons(table(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", 86400)


@query(_beacon_sql(f"select {_host('host')} host, dst_ip, id, epoch_us(ts) at_us from telemetry where event_code = '3' and dst_ip is not null", "host, dst_ip", 300))
def beacon_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telemetry").where("event_code = '3' and dst_ip is not null").select(host_key(F.col("host")).alias("host"), "dst_ip", "id", "ts")
    return _beacons(rows, ["host", "dst_ip"], "id", 300)


# --- correlation and incidents --------------------------------------------------------------------

_TELLING = "user_norm is not null and user_norm not like '%$' and not regexp_matches(user_norm, '^(dwm-|umfd-)') and not starts_with(user_norm, 'font driver host\\') and list_last(string_split(user_norm, '\\')) not in ('system', 'local service', 'network service', 'anonymous logon')"


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end new from events),
n as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) no from g)
select user_id as key, count(*)::bigint n, min(epoch_us(ts)) start_us, max(epoch_us(ts)) end_us from n group by user_id, no""")
def correlate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correlate.keyed_sessions(table(spark, sf_dir, "events"), F.col("user_id"), "ts", 1800)
    return out.select("key", "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


_LINKED = """e as (select a.id a, b.id b from c a join c b on b.us >= a.us and b.us - a.us <= 3600000000 and a.id <> b.id where
  (a.process_uid = b.process_uid and b.us - a.us <= 900000000)
  or (a.telling and b.telling and a.user_norm = b.user_norm and b.us - a.us <= 1800000000)
  or (list_has_any(a.ips, b.ips) and b.us - a.us <= 1800000000)
  or (a.host = b.host and b.us - a.us <= 120000000 and (a.own or b.own))
  or (a.file_path = b.file_path and b.us - a.us > 1800000000)),
both_ways as (select a, b from e union select b, a from e),
walk(id, root) as (select id, id from c union select b, root from walk join both_ways on a = id),
parts as (select id, min(root) component from walk group by id)"""


@query(f"""with recursive {_FIELDS}, {_HITS}, {_KEYED},
c as (select alert_id id, rule_id, epoch_us(ts) us, host, user_norm, process_uid, file_path, list_filter([src_peer, dst_peer], lambda x: x is not null) ips, {_TELLING} telling,
  coalesce(rule_id = 'CUR-021' and user_norm like '%$' and upper(rtrim(user_norm, '$')) = host, false) own from marked where canon = alert_id),
{_LINKED}
select m.alert_id::bigint id, p.component::bigint component from marked m join parts p on p.id = m.canon""")
def correlate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = write_read(_marked(spark, sf_dir), "alerts")
    return correlate.correlate(alerts)


_ROLLED = """select {group}, min(ts) first_seen, max(ts) last_seen, count(*)::bigint raw_alert_count, coalesce(list_sort(list_distinct(list(host) filter (host is not null and host <> '-'))), []) hosts,
    coalesce(list_sort(list_distinct(list(user_norm) filter (user_norm not like '%$'))), []) users, list_sort(list_distinct(list(rule_id))) rules, list_sort(list_distinct(list(tactic))) tactics, bool_or(severity in ('high', 'critical')) severe
  from {rows} group by {group}"""
_CLUSTER = f"{_DETECT}, rolled as ({_ROLLED.format(group='incident_id', rows='(select * from hits where incident_id is not null)')})"
_SCORE = """least(100, (case when list_has_any(rules, ['CUR-005', 'CUR-018']) then 30 else 0 end) + (case when len(hosts) > 1 then 25 else 0 end)
  + (case when list_has_any(rules, ['CUR-012', 'CUR-017', 'CUR-021']) then 20 else 0 end) + (case when list_has_any(rules, ['CUR-004', 'CUR-013']) then 15 else 0 end)
  + (case when list_has_any(rules, ['CUR-006', 'CUR-007', 'CUR-008', 'CUR-009', 'CUR-010', 'CUR-014']) then 10 else 0 end) + least(20, greatest(0, len(tactics) - 1) * 5))"""


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "telemetry").select(F.col("id").alias("event_id"), "incident_id").where("incident_id is not null")
    return _hits(spark, sf_dir).join(owners, "event_id")


@query(f"{_CLUSTER} select incident_id, epoch_us(first_seen) first_us, epoch_us(last_seen) last_us, raw_alert_count, array_to_string(hosts, ',') hosts, array_to_string(users, ',') users, array_to_string(rules, ',') rules from rolled")
def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident.rollup(_clustered(spark, sf_dir), "incident_id")
    return rows.select("incident_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "raw_alert_count", *(F.array_join(c, ",").alias(c) for c in ("hosts", "users", "rules")))


@query(f"{_CLUSTER} select incident_id, ({_SCORE})::int priority, case when ({_SCORE}) > 0 and (raw_alert_count >= 3 or severe) then 'open' else 'suppressed' end status from rolled")
def incident_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident.incidents(_clustered(spark, sf_dir), "incident_id").select("incident_id", "priority", "status")


_EVIDENCE = f"""ids as (select distinct id, uid from (select id, unnest([u1, u2, u3]) uid from f) where uid is not null), pids as (select distinct id, uid from (select id, unnest([q1, q2, q3]) uid from f) where uid is not null),
z as (select distinct al.grp, f.id, f.ts, f.host, f.user_norm, f.own_uid from al join f on f.id = al.id), span as (select grp, min(ts) lo, max(ts) hi from z group by grp), u as (select distinct grp, own_uid uid from z where own_uid is not null),
t1 as (select distinct u.grp, f.id from u join span s using (grp) join ids using (uid) join f on f.id = ids.id where f.ts between s.lo - interval 60 second and s.hi + interval 60 second),
t2 as (select grp, id from (select s.grp, f.id, row_number() over (partition by s.grp, f.host, f.user_norm order by f.ts, f.id) n from (select distinct grp, host, user_norm from z where host is not null and {_TELLING}) u
  join span s using (grp) join f on f.host = u.host and f.user_norm = u.user_norm and f.ts between s.lo - interval 30 second and s.hi + interval 30 second and f.code not in ('4656', '4658', '4663', '4690')) where n <= 60),
t3 as (select distinct u.grp, pids.id from u join pids using (uid)),
best as (select grp, id, min(tier) tier from (select grp, id, 0 tier from z union all select grp, id, 1 from t1 union all select grp, id, 2 from t2 union all select grp, id, 3 from t3) group by grp, id),
ranked as (select b.*, row_number() over (partition by b.grp order by tier, f.ts, b.id) rn from best b join f on f.id = b.id),
kept as (select grp, id, tier from ranked where tier = 0 or rn <= 250)"""
_PIPELINE = f"""{_DETECT.replace("with ", "with recursive ", 1)}, sess as materialized ({_SESSIONS}),
raised as (select id, rule_id, severity, ts from hits where rule_id <> 'CUR-013' or ts is null union all select first_id, 'CUR-013', severity, make_timestamptz(first_us) from sess),
numbered as materialized (select row_number() over (order by r.ts, r.rule_id, r.id) alert_id, r.severity, h.* exclude (severity) from raised r join hits h using (id, rule_id)),
{_greedy_sql("select alert_id id, rule_id, host, user_norm, process_uid, epoch_us(ts) us, command command_line from numbered")},
c as materialized (select alert_id id, rule_id, epoch_us(ts) us, host, user_norm, process_uid, file_path, list_filter([src_peer, dst_peer], lambda x: x is not null) ips, {_TELLING} telling,
  coalesce(rule_id = 'CUR-021' and user_norm like '%$' and upper(rtrim(user_norm, '$')) = host, false) own from numbered n join marks m on m.id = n.alert_id where m.owner is null),
{_LINKED},
told as materialized (select n.*, m.key, m.owner, p.component from numbered n join marks m on m.id = n.alert_id join parts p on p.id = coalesce(m.owner, m.id))"""


@query(f"{_PIPELINE} select alert_id::bigint id, id event_id, rule_id, severity, key dedup_key, owner is not null is_duplicate, owner::bigint canonical_id, component::bigint component from told")
def pipeline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's alerts with their marks and the component that each, duplicates too, belongs to."""
    done = pipeline.run(spark, sf_dir)
    rows = done.alerts.join(done.clusters, "id", "left")
    return rows.select("id", "event_id", "rule_id", "severity", "dedup_key", "is_duplicate", "canonical_id", "component")


@query(f"""{_PIPELINE}, al as (select distinct component grp, id from told), {_EVIDENCE},
rolled as ({_ROLLED.format(group="component", rows="told")})
select component::bigint incident, epoch_us(first_seen) first_us, epoch_us(last_seen) last_us, raw_alert_count, (select count(*) from kept k where k.grp = component)::bigint event_count, ({_SCORE})::int priority,
  case when ({_SCORE}) > 0 and (raw_alert_count >= 3 or severe) then 'open' else 'suppressed' end status, array_to_string(hosts, ',') hosts from rolled""")
def pipeline_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.run(spark, sf_dir).incidents
    return rows.select("incident", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "raw_alert_count", "event_count", "priority", "status", F.array_join("hosts", ",").alias("hosts"))


@query("select incident_id, id, row_number() over (partition by incident_id order by ts, coalesce(event_code, ''), id) as position from telemetry where incident_id is not null")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident.timeline(table(spark, sf_dir, "telemetry").where("incident_id is not null"), "incident_id")
    return rows.select("incident_id", "id", F.col("position").cast("bigint").alias("position"))


_THINGS = f"""with docs as (select *, {_DOC} o from telemetry where incident_id is not null),
n as (select id, ts, incident_id, {_host(_f('host', '$.device.hostname', '$.unmapped.Hostname'))} h, {_user(_f('user_name', '$.actor.user.name', '$.unmapped.User', '$.unmapped.SubjectUserName'))} u,
  {_path(_f('process_name', '$.process.file.path', '$.unmapped.Image', '$.unmapped.NewProcessName'))} p, {_path(_f('parent_process', '$.process.parent_process.file.path', '$.unmapped.ParentImage'))} pp,
  {_path(_f('file_path', '$.file.path', '$.unmapped.TargetFilename'))} f, {_ip(_f('dst_ip', '$.dst_endpoint.ip'))} d, {_ip(_f('src_ip', '$.src_endpoint.ip'))} s from docs)"""
_EACH = " union all ".join(f"select incident_id, id, ts, '{kind}' kind, {c} as value from n where {c} is not null" for c, kind in (("h", "host"), ("u", "user"), ("p", "process"), ("pp", "process"), ("f", "file"), ("d", "ip"), ("s", "ip")))
_LINKS = " union all ".join(
    f"select incident_id, id, '{ka}' src_kind, {a} src_value, '{kb}' dst_kind, {b} dst_value, '{name}' relation from n where {a} is not null and {b} is not null and {extra}"
    for a, ka, b, kb, name, extra in (("u", "user", "p", "process", "executed", "true"), ("pp", "process", "p", "process", "spawned", "pp <> p"), ("p", "process", "f", "file", "wrote", "p <> f"), ("p", "process", "d", "ip", "connected_to", "true"), ("h", "host", "u", "user", "authenticated_as", "u not like '%$'"))
)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "telemetry").where("incident_id is not null")


def _entity_id_sql(kind: str, value: str) -> str:
    return f"sha256(concat_ws('|', incident_id::varchar, {kind}, {value}))"


@query(f"{_THINGS} select incident_id, kind, value, {_entity_id_sql('kind', 'value')} entity_id, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us, count(distinct id)::bigint n_events, min(id) first_id from ({_EACH}) group by incident_id, kind, value")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident.entities(_told(spark, sf_dir), "incident_id")
    return rows.select("incident_id", "kind", "value", "entity_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n_events", "first_id")


@query(f"{_THINGS} select distinct incident_id, kind, value, id from ({_EACH})")
def entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident.entity_events(_told(spark, sf_dir), "incident_id")


@query(f"{_THINGS} select incident_id, src_kind, src_value, dst_kind, dst_value, relation, count(distinct id)::bigint n_events, min(id) first_id, {_entity_id_sql('src_kind', 'src_value')} src_id, {_entity_id_sql('dst_kind', 'dst_value')} dst_id from ({_LINKS}) group by all")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident.entity_edges(_told(spark, sf_dir), "incident_id")


@query(f"{_THINGS} select distinct incident_id, src_kind, src_value, dst_kind, dst_value, relation, id from ({_LINKS})")
def entity_edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incident.entity_edge_events(_told(spark, sf_dir), "incident_id")


@query(f"""{_THINGS}, ent as (select distinct incident_id, kind, value, {_entity_id_sql('kind', 'value')} entity_id from ({_EACH}))
select l.incident_id, a.entity_id src_id, b.entity_id dst_id, relation, count(distinct l.id)::bigint n_events from ({_LINKS}) l
join ent a on a.incident_id = l.incident_id and a.kind = l.src_kind and a.value = l.src_value join ent b on b.incident_id = l.incident_id and b.kind = l.dst_kind and b.value = l.dst_value group by all""")
def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends resolved by joins with the entity table."""
    told = _told(spark, sf_dir)
    edges = incident.resolved_edges(incident.entity_edges(told, "incident_id"), incident.entities(told, "incident_id"), "incident_id")
    return edges.select("incident_id", "src_id", "dst_id", "relation", "n_events")


@query(f"{_DETECT}, al as (select distinct incident_id grp, id from hits where incident_id is not null), {_EVIDENCE} select grp incident_id, id, tier from kept")
def evidence_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "telemetry")
    fields = pipeline.fields_of(events)
    owners = events.select(F.col("id").alias("event_id"), "incident_id").where("incident_id is not null")
    alerting = rules.fired(fields, codes=rules.CANDIDATE_CODES).select("event_id").join(owners, "event_id")
    return incident.evidence(fields, alerting, "incident_id")


# --- parsing and normalisation ----------------------------------------------------------------------


@query(f"""select id, {_host('host')} host, {_user('user_name')} user_norm, coalesce({_user('user_name')} like '%$', false) is_machine, coalesce({_TELLING.replace('user_norm', _user('user_name'))}, false) is_telling,
{_path('process_name')} process, {_ip('src_ip')} src_ip, {_ip('dst_ip')} dst_ip from telemetry""")
def normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = user_key(F.col("user_name"))
    return table(spark, sf_dir, "telemetry").select(
        "id", host_key(F.col("host")).alias("host"), user.alias("user_norm"), is_machine_account(user).alias("is_machine"), is_correlating_user(user).alias("is_telling"),
        windows_path(F.col("process_name")).alias("process"), routable_ip(F.col("src_ip")).alias("src_ip"), routable_ip(F.col("dst_ip")).alias("dst_ip"),
    )


@query(f"select id, {_uid('process_uid')} process_uid from alerts")
def normalize_process_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alerts").select("id", process_uid(F.col("process_uid")).alias("process_uid"))


def _member_sql(name: str) -> str:
    """A record's text by name in any layout: listed event data (the last of equal names), else event data by key, else the top level."""
    listed = f"list_filter(case json_type(r, '$.Event.EventData.Data') when 'ARRAY' then json_extract(r, '$.Event.EventData.Data')::json[] when 'OBJECT' then [json_extract(r, '$.Event.EventData.Data')] else [] end, lambda d: json_extract_string(d, '$.Name') = '{name}')[-1]"
    return f"coalesce(json_extract_string({listed}, '$.Value'), json_extract_string(r, '$.winlog.event_data.{name}'), json_extract_string(r, '$.{name}'))"


_RECORDS = f"texts as (select id, {_DOC.replace('ocsf', 'raw')} t from telemetry), records as materialized (select id, t::json r from texts where json_valid(t) and json_type(t::json) = 'OBJECT')"


@query(f"""with {_RECORDS}, v as (select id, string_split({_member_sql('Hashes')}, ',') ps from records), h as (select id, unnest(ps) p, len(list_filter(ps, lambda x: not regexp_matches(x, '^[^=]+=.+$'))) bad from v)
select id, split_part(p, '=', 1) algorithm, substr(p, instr(p, '=') + 1) as value from h where bad = 0""")
def hashes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash lists of the source records, in every layout."""
    rows = with_record(table(spark, sf_dir, "telemetry").select("id", "raw"), "raw", "m")
    return rows.select("id", F.explode(parse.hash_list(F.try_element_at("m", F.lit("Hashes")))).alias("h")).select("id", F.col("h.algorithm").alias("algorithm"), F.col("h.value").alias("value"))


@query(f"""with {_RECORDS}, v as (select id, {_member_sql('ProcessId')} p, {_member_sql('port')} q from records)
select id, case when regexp_matches(p, '^0[xX][0-9a-fA-F]+$') then try_cast(lower('0x' || substr(p, 3)) as bigint) else try_cast(case when regexp_matches(p, '^[+-]?[0-9]+$') then p end as bigint) end pid,
case when regexp_matches(q, '^[0-9]+$') and try_cast(q as hugeint) <= 65535 then q::int end port from v""")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process ids and ports of the source records, in every layout."""
    rows = with_record(table(spark, sf_dir, "telemetry").select("id", "raw"), "raw", "m").where("m is not null")
    return rows.select("id", parse.number_value(F.try_element_at("m", F.lit("ProcessId"))).alias("pid"), parse.port_value(F.try_element_at("m", F.lit("port"))).alias("port"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "telemetry").select("uid", "raw", "ingested_at")).withColumn("dataset", F.split_part("uid", F.lit("/"), F.lit(1)))
    rows = rows.join(table(spark, sf_dir, "datasets").select("dataset", "event_time_offset"), "dataset", "left")
    return parse_records(rows, "uid", "raw", F.col("event_time_offset"), F.col("ingested_at"))


@query()
def record_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).withColumns({"document": F.to_json("document"), "unmapped": F.to_json("unmapped")}).drop("raw")


def _text_sql(name: str) -> str:
    return f"nullif(nullif({_member_sql(name)}, ''), '-')"


@query(f"""with texts as (select uid, {_DOC.replace('ocsf', 'raw')} t from telemetry), records as materialized (select uid, t::json r from texts where json_valid(t) and json_type(t::json) = 'OBJECT'),
e as (select *, nullif(nullif(coalesce(json_extract_string(r, '$.winlog.channel'), json_extract_string(r, '$.Event.System.Provider.Name'), json_extract_string(r, '$.Channel')), ''), '-') channel,
  try_cast(coalesce(json_extract_string(r, '$.winlog.event_id'), json_extract_string(r, '$.Event.System.EventID'), json_extract_string(r, '$.EventID')) as bigint) n,
  nullif(nullif(coalesce(json_extract_string(r, '$.Event.System.Computer'), case when json_type(r, '$.host') = 'OBJECT' then json_extract_string(r, '$.host.name') end, json_extract_string(r, '$.Hostname')), ''), '-') host,
  {_text_sql('ObjectName')} obj, {_text_sql('ObjectType')} kind, {_text_sql('Image')} image, {_text_sql('SourceImage')} source_image, {_text_sql('NewProcessName')} started, {_text_sql('ProcessName')} holder, {_text_sql('Application')} application,
  {_text_sql('CallerProcessName')} caller, {_text_sql('TargetFilename')} target from records),
c as (select *, case lower(channel) when 'microsoft-windows-sysmon/operational' then 'sysmon' when 'security' then 'winsec' when 'microsoft-windows-powershell/operational' then 'powershell' when 'windows powershell' then 'powershell' else 'winevt' end source from e where channel is not null and n is not null),
k as (select *, case when source = 'sysmon' then case when n in (1, 5, 8, 10) then 1007 when n in (2, 11, 15, 23) then 1001 when n = 3 then 4001 when n = 7 then 1005 when n = 12 then 201001 when n = 13 then 201002 when n = 22 then 4003 else 0 end
  when source = 'winsec' then case when n in (4688, 4689) then 1007 when n in (4624, 4634, 4647, 4648, 4768, 4769, 4776) then 3002 when n = 4672 then 3003 when n in (4720, 4722, 4724, 4738) then 3001 when n in (4728, 4732) then 3006 when n = 4657 then 201002
    when n in (5154, 5156, 5157, 5158) then 4001 when n in (4656, 4663) and obj is not null then case kind when 'File' then 1001 when 'Key' then 201001 when 'Process' then 1007 else 0 end else 0 end else 0 end class_uid from c)
select uid, source, n::varchar event_code, host, class_uid::int class_uid,
  (case when source = 'sysmon' then case n when 1 then 1 when 2 then 6 when 3 then 1 when 5 then 2 when 7 then 1 when 8 then 4 when 10 then 3 when 11 then 1 when 13 then 2 when 15 then 1 when 22 then 1 when 23 then 4 else 0 end
  when source = 'winsec' then case when n in (4688, 4624, 4648, 4672, 4776, 4720, 5156) then 1 when n in (4689, 4634, 4647, 4722) then 2 when n in (4768, 4728, 4732, 4657) then 3 when n in (4769, 4724) then 4 when n in (4738, 5158) then 99 when n = 5154 then 7 when n = 5157 then 5
    when class_uid = 1001 then case n when 4656 then 14 else 99 end when class_uid = 201001 then 99 when class_uid = 1007 then 3 else 0 end else 0 end)::int activity_id,
  case when source = 'sysmon' then case when n in (8, 10) then source_image else image end when source = 'winsec' then case when n = 4688 then started when n in (5154, 5156, 5157, 5158) then application when n in (4798, 4799) then caller
    when n in (4634, 4647, 4672, 4768, 4769, 4776, 4720, 4722, 4724, 4738, 4728, 4732, 5140, 5145) then null else holder end end process_name,
  case when source = 'sysmon' and class_uid = 1001 then target when source = 'winsec' and class_uid = 1001 then obj end file_path from k""")
def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of record_parse that hang on the mapping of the events, for all records with a channel and a number."""
    rows = _parsed(spark, sf_dir).where(F.col("reject").isNull() | (F.col("reject") == "no time"))
    return rows.select("uid", "source", "event_code", "host", "class_uid", "activity_id", "process_name", "file_path")


@query()
def reject_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by each reason for which record_parse takes none."""
    return reject_counts(_parsed(spark, sf_dir))


def _raw_sql(name: str) -> str:
    return f"nullif({_member_sql(name)}, '')"


def _kept_sql(name: str) -> str:
    return f"coalesce({_raw_sql(name)}, nullif(json_extract_string(o, '$.unmapped.{name}'), ''))"


_LINE_PARTS = [
    ("TS", "strftime(timezone('UTC', ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"), ("Host", "nullif(host, '')"), ("User", f"coalesce(nullif(user_name, ''), {_raw_sql('AccountName')}, {_raw_sql('TargetUserName')})"), ("Code", "coalesce(code, '')"),
    ("Proc", f"coalesce(nullif(process_name, ''), {_raw_sql('SourceImage')}, {_raw_sql('ProcessName')})"), ("Parent", f"coalesce(nullif(parent_process, ''), {_raw_sql('ParentImage')})"), ("Cmd", f"coalesce(nullif(command_line, ''), {_raw_sql('CommandLine')})"),
    ("TargetProc", f"coalesce({_raw_sql('TargetImage')}, nullif(json_extract_string(o, '$.process.file.path'), ''), nullif(json_extract_string(o, '$.process.name'), ''))"), ("GrantedAccess", _kept_sql("GrantedAccess")),
    ("ScriptBlock", f"substr(trim(regexp_replace({_raw_sql('ScriptBlockText')}, '\\s+', ' ', 'g')), 1, 300)"),
    ("Net", "case when src is not null or dst is not null then coalesce(src, '') || '->' || coalesce(dst, '') || case when rp <> op then ':' || op || ' (RawLog DestinationPort=' || rp || ' CONFLICT)' else coalesce(':' || coalesce(rp, op), '') end end"),
    ("Share", _kept_sql("ShareName")), ("ShareFile", _kept_sql("RelativeTargetName")), ("Service", _kept_sql("ServiceName")), ("ServiceImage", f"coalesce({_raw_sql('ImagePath')}, {_raw_sql('ServiceFileName')})"), ("RegKey", _kept_sql("TargetObject")),
    ("File", f"coalesce({_raw_sql('TargetFilename')}, nullif(file_path, ''))"),
]


@query(f"""with docs as (select *, {_DOC} o, {_DOC.replace('ocsf', 'raw')} t from telemetry where incident_id is not null), d as (select *, case when json_valid(t) and json_type(t::json) = 'OBJECT' then t::json end r from docs),
e as (select *, coalesce(nullif(event_code, ''), nullif(coalesce(json_extract_string(r, '$.winlog.event_id'), json_extract_string(r, '$.Event.System.EventID'), json_extract_string(r, '$.EventID')), '')) code,
  coalesce(nullif(src_ip, ''), {_raw_sql('SourceIp')}) src, coalesce(nullif(dst_ip, ''), {_raw_sql('DestinationIp')}) dst, {_raw_sql('DestinationPort')} rp, nullif(json_extract_string(o, '$.dst_endpoint.port'), '') op from d)
select incident_id, id, concat_ws(' | ', 'Event ' || id, {", ".join(f"'{k}=' || {v}" for k, v in _LINE_PARTS)}) line from e""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["incident_id", "id", "ts", "host", "user_name", "event_code", "process_name", "parent_process", "command_line", "file_path", "src_ip", "dst_ip"]
    rows = with_record(_told(spark, sf_dir).select(*columns, "ocsf", "raw"), "raw", "m")
    rows = rules.with_document(rows, [*columns, "m"])
    return rows.select("incident_id", "id", event_line(F.col("m"), F.col("o")).alias("line"))


@query("select id, coalesce(title, 'Incident #' || id || ' (' || array_to_string(hosts, ', ') || ')') title, strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f') first_seen from incidents")
def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = F.concat(F.lit("Incident #"), F.col("id").cast("string"), F.lit(" ("), F.array_join("hosts", ", "), F.lit(")"))
    rows = table(spark, sf_dir, "incidents")
    return rows.select("id", F.coalesce("title", default).alias("title"), F.date_format(F.to_utc_timestamp("first_seen", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("first_seen"))


# --- search and retrieval ---------------------------------------------------------------------------

_FILTERS = {
    "codes": {"event_codes": ["1", "4688"]},
    "hosts": {"hosts": ["brantak48", "HAVDEX48.quillmere.example"], "event_codes": ["3"]},
    "process": {"process_names": ["powershell.exe", "CMD.EXE"]},
    "command": {"command_line_contains": ["-q", "slot a"]},
    "time": {"time_after": "2024-02-06 00:00:00", "time_before": "2024-02-06 06:00:00"},
    "incident": {"incident_id": 2, "max": 25},
}
_FILTER_SQL = {
    "codes": "event_code in ('1', '4688')",
    "hosts": f"{_host('host')} in ('BRANTAK48', 'HAVDEX48') and event_code = '3'",
    "process": "lower(process_name) like '%powershell.exe' or lower(process_name) like '%cmd.exe'",
    "command": "contains(lower(command_line), '-q') and contains(lower(command_line), 'slot a')",
    "time": "ts >= timestamptz '2024-02-06 00:00:00+00' and ts <= timestamptz '2024-02-06 06:00:00+00'",
    "incident": "incident_id = 2",
}


@query(" union all ".join(f"(select '{k}' tag, id, epoch_us(ts) ts_us from telemetry where {v} order by ts, id limit {_FILTERS[k].get('max', 50)})" for k, v in _FILTER_SQL.items()))
def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "telemetry")
    out = None
    for tag, filters in _FILTERS.items():
        rows = search.filter_search(events, filters, filters.get("max", 50)).select(F.lit(tag).alias("tag"), "id", F.unix_micros("ts").alias("ts_us"))
        out = rows if out is None else out.unionByName(rows)
    return out


_COS = "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))))"
_NEAR = f"near as (select q.vec_id query_id, e.vec_id, {_COS} distance from embeddings e, embeddings q where q.vec_id % 50 = 0), best as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from near)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.vector_topk_all(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


@query(f"with {_NEAR} select query_id, vec_id, rank::int as rank, round(distance, 6) + 0.0 distance from best where rank <= 50")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query."""
    return _near(spark, sf_dir).select("query_id", "vec_id", "rank", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


_TEXT_QUERY = "encoded powershell script observed on the endpoint during shift handover"
_STOP = "['a','an','and','are','as','at','be','by','for','from','in','is','it','no','not','of','on','or','that','the','this','to','was','were','with']"
_STEMS = rf"list_transform(list_filter(regexp_extract_all(lower({{t}}), '[\p{{{{L}}}}\p{{{{N}}}}]{{{{2,}}}}'), lambda w: not list_contains({_STOP}, w)), lambda w: regexp_replace(w, '^(.{{{{3,}}}}?)(?:ing|ed|es|s|e)$', '\1'))".replace("{{{{", "{{").replace("}}}}", "}}")
_KEYWORD = f"""q as (select list_distinct({_STEMS.format(t="'" + _TEXT_QUERY + "'")}) w), st as (select doc_id, {_STEMS.format(t="text")} s from documents where text is not null),
kw as (select doc_id, round(len(h) * 0.1::double, 9) score from (select doc_id, s, list_filter(s, lambda x: list_contains(w, x)) h from st, q) where len(h) > 0),
kr as (select *, row_number() over (order by score desc, doc_id) as rank from kw order by score desc, doc_id limit 50)"""


@query(f"with {_KEYWORD} select doc_id, score, rank::int as rank from kr")
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_rank(table(spark, sf_dir, "documents"), "doc_id", "text", _TEXT_QUERY)


_KEYWORD_ALL = f"""st as (select doc_id, {_STEMS.format(t="text")} s from documents where text is not null), qs as (select doc_id query_id, list_distinct(s) w from st where doc_id % 50 = 0),
kw as (select query_id, doc_id, round(len(h) * 0.1::double, 9) score from (select query_id, doc_id, s, list_filter(s, lambda x: list_contains(w, x)) h from st, qs) where len(h) > 0),
kr as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from kw) where rank <= 50)"""


@query(f"""with {_KEYWORD_ALL}, {_NEAR}, v as (select query_id, vec_id doc_id, rank from best where rank <= 50), s as (
  select query_id, doc_id, coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + kr.rank), 0) score from v full outer join kr using (query_id, doc_id))
select query_id, doc_id, round(score, 9) score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 20""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id divisible by 50 as a query, by its vector and its document's text, where it has them."""
    docs = table(spark, sf_dir, "documents")
    words = search.keyword_rank_all(docs, "doc_id", "text", docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))
    out = search.reciprocal_rank_fusion(_near(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), words, "doc_id", 20, by=["query_id"])
    return out.withColumn("score", F.round("score", 9))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\b[\w.-]+\.quillmere\.example\b', '', 'gi'), '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?::\d+)?\b', '', 'g'), '\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\.\d+)?\b', '', 'g'), '\s+', ' ', 'g'))"
# Fixed values, written out again for the SQL: what ports and event codes stand for, and words that ask for more terms.
_PORT_SQL = """case when port in (80, 8080, 8000) then 'HTTP web protocols web traffic application layer' when port in (443, 8443) then 'HTTPS TLS HTTP web protocols web traffic application layer communication'
when port = 53 then 'DNS' when port = 445 then 'SMB Windows admin shares file sharing' when port = 5985 then 'WinRM Windows Remote Management remote services PowerShell remoting'
when port = 5986 then 'WinRM Windows Remote Management remote services PowerShell remoting HTTPS' when port = 3389 then 'RDP remote desktop remote services' when port = 135 or port between 49152 and 65535 then 'RPC DCOM'
when port in (88, 464) then 'Kerberos' when port in (389, 636) then 'LDAP directory' end"""
_CODE_SQL = """case event_code when '1' then 'process creation execution' when '3' then 'network connection' when '10' then 'process access memory credential' when '11' then 'file creation' when '12' then 'registry modification'
when '13' then 'registry modification' when '4688' then 'process creation' when '4697' then 'service installation persistence' when '7045' then 'service installation persistence' when '4698' then 'scheduled task persistence'
when '5140' then 'network share access' when '5145' then 'network share access' when '4104' then 'script block PowerShell execution' end"""
_ASKED_SQL = [
    ("‮|â€®|right-to-left|rtlo", "right-to-left override RTLO unicode filename reversal masquerading"),
    ("sdelete|del |erase|remove-item|wevtutil|cipher /w|secure-delet|destroy evidence|evidence destruction", "indicator removal file deletion anti-forensics evidence destruction secure delete"),
    (r"downloadfile|downloadstring|invoke-webrequest|certutil -urlcache|certutil -f|bitstransfer|start-bitstransfer|webclient|net\.webclient", "ingress tool transfer download file remote host tool staging T1105 lateral tool transfer"),
    ("wsmprovhost|5985|5986|winrm|wsman|powershell remoting", "windows remote management WinRM remote services lateral movement T1021.006 PowerShell remoting wsmprovhost"),
    ("zip|rar|compress|createfromdirectory|stage|staging|poshspy|zipfile|archive", "data staged local data staging collection archive compress T1074"),
]


@query(f"""with docs as (select id, command_line, process_name, file_path, event_code, {_DOC} o from telemetry where command_line is not null),
e as (select *, case when regexp_matches(json_extract_string(o, '$.dst_endpoint.port'), '^[0-9]{{1,9}}$') then json_extract_string(o, '$.dst_endpoint.port')::int end port, json_extract_string(o, '$.unmapped.ShareName') share from docs),
t as (select id, command_line, list_filter([case when process_name <> '' then {_CLEAN.format(c='process_name')} end, case when substr(command_line, 1, 120) <> '' then {_CLEAN.format(c='substr(command_line, 1, 120)')} end,
  case when file_path <> '' then {_CLEAN.format(c='file_path')} end, case when share <> '' then {_CLEAN.format(c='share')} end, {_PORT_SQL}, {_CODE_SQL}], lambda x: x is not null) terms from e),
w as (select *, lower(command_line || ' ' || array_to_string(terms, ' ')) spoken from t),
k as (select *, list_filter(terms, lambda x: not (regexp_matches(spoken, '{_ASKED_SQL[1][0]}') and contains(x, 'process creation'))) kept from w)
select id, trim({_CLEAN.format(c='command_line')} || ' ' || concat_ws(' ', {", ".join(f"case when regexp_matches(spoken, '{words}') then '{terms}' end" for words, terms in _ASKED_SQL)}) || ' '
  || array_to_string((list_filter(kept, lambda x, i: list_position(kept, x) = i))[1:20], ' ')) as query from k""")
def query_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval query of every command line, enriched from its own event."""
    columns = ["id", "command_line", "process_name", "file_path", "event_code"]
    rows = rules.with_document(table(spark, sf_dir, "telemetry").where("command_line is not null"), columns)
    port = F.when(F.col("o.dst_endpoint.port").rlike(r"^\d{1,9}$"), F.col("o.dst_endpoint.port").cast("int"))
    share = F.try_element_at("o.unmapped", F.lit("ShareName"))
    rows = pinned(rows, {"terms": search.context_terms(F.col("process_name"), F.col("command_line"), F.col("file_path"), port, F.col("event_code"), share, "quillmere.example")})
    return rows.select("id", search.enriched_query(F.col("command_line"), F.col("terms"), "quillmere.example").alias("query"))


@query("""select rule_id, 'Represent this sentence for searching relevant passages: ' || rule_name as query, rule_name || '. ' || severity as passage from detection_rules""")
def retrieval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a query and of a passage."""
    rows = table(spark, sf_dir, "detection_rules")
    return rows.select("rule_id", search.query_text(F.col("rule_name")).alias("query"), search.passage_text(F.col("rule_name"), F.col("severity")).alias("passage"))


# --- audit, accuracy, sinks --------------------------------------------------------------------------


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log of the incidents' creation. Each hash needs the one before: one task streams the sorted rows."""
    shown = F.concat(F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    detail = F.concat(F.lit('{"incident":'), F.col("id").cast("string"), F.lit(',"priority":'), F.coalesce(F.col("priority").cast("string"), F.lit("null")), F.lit("}"))
    rows = table(spark, sf_dir, "incidents").select("id", F.col("created_at").alias("ts"), F.lit("pipeline").alias("actor"), F.coalesce("status", F.lit("")).alias("action"), detail.alias("detail"), shown.alias("shown"))
    return write_read(audit.chained(rows), "chain")


@query("select 'intact' variant, true ok, count(*)::bigint n_entries, null::bigint broken_at from incidents union all select 'tampered', false, count(*)::bigint, 2 from incidents")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _chain(spark, sf_dir)
    tampered = log.withColumn("detail", F.when(F.col("id") == 2, F.lit("{}")).otherwise(F.col("detail")))
    return audit.verify(log).withColumn("variant", F.lit("intact")).unionByName(audit.verify(tampered).withColumn("variant", F.lit("tampered")))


_RECOVERED = "rec as (select distinct unnest(technique_ids) id from alerts where severity in ('high', 'critical')), tru as (select distinct unnest(technique_ids) id from detection_rules where severity <> 'low' union select split_part(x, '.', 1) from (select unnest(technique_ids) x from detection_rules where severity = 'critical'))"
_MATCH = r"""m as (select id, truth_id, case when truth_id is null then 'beyond' when id = truth_id then 'exact' else 'related' end as match from (
  select r.id, t.id truth_id, row_number() over (partition by r.id order by (r.id = t.id) desc nulls last, t.id nulls last) n from rec r left join tru t on r.id = t.id or starts_with(r.id, t.id || '.') or starts_with(t.id, r.id || '.')) where n = 1)"""


def _recovered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = table(spark, sf_dir, "alerts").where("severity in ('high', 'critical')").select(F.explode("technique_ids").alias("id")).distinct()
    known = table(spark, sf_dir, "detection_rules")
    tru = known.where("severity <> 'low'").select(F.explode("technique_ids").alias("id"))
    tru = tru.union(known.where("severity = 'critical'").select(F.explode("technique_ids").alias("x")).select(F.split_part("x", F.lit("."), F.lit(1)))).distinct()
    return rec, tru


@query(f"with {_RECOVERED}, {_MATCH} select id, match, truth_id from m")
def technique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.match_techniques(*_recovered(spark, sf_dir))


@query(f"""with {_RECOVERED}, {_MATCH} select count(*)::bigint n_recovered, count(*) filter (match = 'exact')::bigint n_exact, count(*) filter (match = 'related')::bigint n_related, count(*) filter (match = 'beyond')::bigint n_beyond,
count(distinct truth_id)::bigint n_truth_matched, (select count(*) from tru)::bigint n_truth, round(count(*) filter (match <> 'beyond') / count(*), 4) as precision, round(count(distinct truth_id) / (select count(*) from tru), 4) recall from m""")
def accuracy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.accuracy(*_recovered(spark, sf_dir))


@query(f"with {_RECOVERED}, {_MATCH} select id from tru where id not in (select truth_id from m where truth_id is not null)")
def missed_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.missed(*_recovered(spark, sf_dir))


# Alerts stand in for sentences, their grades for verdicts: there is no table of either.
_JUDGED = """s as (select id, incident_id, event_id, unnest(technique_ids) technique_id from alerts), v as (select id sentence_id, severity in ('high', 'critical') supported from alerts where severity <> 'low'),
j as (select s.*, v.supported from s join v on v.sentence_id = s.id join incidents i on i.id = s.incident_id and i.status <> 'suppressed')"""


def _sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    alerts = table(spark, sf_dir, "alerts")
    verdicts = alerts.where("severity <> 'low'").select(F.col("id").alias("sentence_id"), F.col("severity").isin("high", "critical").alias("supported"))
    return alerts.select("id", "incident_id", F.explode("technique_ids").alias("technique_id")), verdicts, table(spark, sf_dir, "incidents").select("id", "status")


@query(f"with {_JUDGED} select distinct technique_id id from j where supported")
def supported_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.supported_techniques(*_sentences(spark, sf_dir))


@query(f"with {_JUDGED} select distinct technique_id id from j where not supported and technique_id not in (select technique_id from j where supported)")
def not_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Techniques claimed by unsupported sentences only."""
    return accuracy.unsupported_only(*_sentences(spark, sf_dir))


@query(f"""with {_JUDGED}, known as (select distinct unnest(technique_ids) id from detection_rules where severity = 'critical'), beyond as (select distinct technique_id id from j where supported and technique_id not in (select id from known))
select distinct j.technique_id, j.incident_id, j.id sentence_id, e.id event_id, e.process_name, trim(coalesce(nullif(e.command_line, ''), case when json_valid(e.raw) then coalesce(nullif(json_extract_string(e.raw, '$.CommandLine'), ''), nullif(json_extract_string(e.raw, '$.Message'), '')) end, '')) command
from j join beyond b on b.id = j.technique_id join telemetry e on e.id = j.event_id where supported""")
def technique_justifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands behind supported techniques that no critical rule names."""
    judged = _sentences(spark, sf_dir)
    known = table(spark, sf_dir, "detection_rules").where("severity = 'critical'").select(F.explode("technique_ids").alias("id"))
    beyond = accuracy.supported_techniques(*judged).join(known, "id", "left_anti")
    cited = table(spark, sf_dir, "alerts").select(F.col("id").alias("sentence_id"), "event_id")
    return accuracy.justifications(*judged, beyond, cited, table(spark, sf_dir, "telemetry"))


@query("select incident_id, count(*) filter (severity is null or severity = 'low')::bigint n_unverified from alerts where incident_id is not null group by incident_id")
def unverified_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts, _ = _sentences(spark, sf_dir)
    return accuracy.unverified(table(spark, sf_dir, "alerts").select("id", "incident_id"), verdicts)


@query("select id, row_number() over (order by priority desc, first_seen, id) as position from incidents where status <> 'suppressed'")
def incident_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaced incidents as they are listed: by priority, then first_seen, then id."""
    rows = table(spark, sf_dir, "incidents").where("status <> 'suppressed'").select("id", "priority", "first_seen")
    return numbered(rows, [F.col("priority").desc_nulls_first(), F.col("first_seen").asc_nulls_last(), F.col("id")], "position").select("id", "position")


@query("select incident_id, id from (select incident_id, id, row_number() over (partition by incident_id order by ts, coalesce(event_code, ''), id) n from telemetry where incident_id is not null) where n <= 15")
def timeline_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 events of every incident."""
    return incident.timeline(_told(spark, sf_dir), "incident_id").where("position <= 15").select("incident_id", "id")


@query("select rule_id, t as technique_id from detection_rules, (select distinct unnest(technique_ids) t from alerts where severity = 'critical') where list_contains(technique_ids, t)")
def technique_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose array of hints holds a technique of a critical alert."""
    wanted = table(spark, sf_dir, "alerts").where("severity = 'critical'").select(F.explode("technique_ids").alias("technique_id")).distinct()
    return search.members(table(spark, sf_dir, "detection_rules"), "technique_ids", wanted, "technique_id").select("rule_id", "technique_id")


@query("select id, uid, event_code from telemetry where id in (select event_id from alerts)")
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with given ids."""
    wanted = table(spark, sf_dir, "alerts").select(F.col("event_id").alias("id"))
    return search.by_ids(table(spark, sf_dir, "telemetry"), wanted, "id").select("id", "uid", "event_code")


@query("""with old as (select first_seen, array_to_string(list_sort(hosts), chr(0)) k, max(id) id from incidents where status <> 'suppressed' group by all),
new as (select first_seen, array_to_string(list_sort(hosts), chr(0)) k, max(raw_alert_count) n from incidents group by all), j as (select new.*, old.id from new left join old on old.first_seen is not distinct from new.first_seen and old.k = new.k)
select coalesce(id, (select max(id) from incidents where status <> 'suppressed') + row_number() over (partition by id is null order by first_seen, k))::bigint id, n::bigint raw_alert_count, case when id is null then 'insert' else 'update' end as change from j""")
def incident_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surfaced incidents as stored, all of them as found anew: matched by first_seen and hosts."""
    rows = table(spark, sf_dir, "incidents")
    found = rows.groupBy("first_seen", F.array_sort("hosts").alias("hosts")).agg(F.max("raw_alert_count").alias("raw_alert_count"))
    out = upsert.upsert_incidents(rows.where("status <> 'suppressed'").select("id", "first_seen", "hosts"), found)
    return out.select("id", F.col("raw_alert_count").cast("bigint").alias("raw_alert_count"), "change")


@query("""select coalesce(split_part(t, '.', 1), t) id, array_to_string(list_sort(list_distinct(list(t))), ',') shipped from (select distinct unnest(technique_ids) t from detection_rules) group by 1""")
def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "detection_rules").select(F.explode("technique_ids").alias("technique_id")).distinct()
    replaced = truth.select(F.col("technique_id").alias("old"), F.split_part("technique_id", F.lit("."), F.lit(1)).alias("new"))
    return accuracy.resolve_ids(truth, "technique_id", replaced).withColumn("shipped", F.array_join("shipped", ","))


@query("""select uid, min(id) id from telemetry where uid not in (select uid from telemetry where source = 'sysmon' and uid is not null) group by uid""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telemetry").select("uid", "id", "source")
    return upsert.new_rows(rows, rows.where("source = 'sysmon'"), "uid", ["id"]).select("uid", "id")


_OLD = "select c_custkey, c_name, c_acctbal from customer where c_nationkey < 20"
_NEW = "select c_custkey, c_name, case when c_mktsegment = 'BUILDING' then c_acctbal + 1 else c_acctbal end c_acctbal from customer where c_nationkey >= 5"


@query(f"""select coalesce(n.c_custkey, o.c_custkey) c_custkey, coalesce(n.c_name, o.c_name) c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 2) c_acctbal,
case when o.c_custkey is null then 'insert' when n.c_custkey is null then 'delete' when o.c_name is not distinct from n.c_name and o.c_acctbal is not distinct from n.c_acctbal then 'same' else 'update' end as change
from ({_OLD}) o full outer join ({_NEW}) n on o.c_custkey = n.c_custkey""")
def upsert_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    old = rows.where("c_nationkey < 20")
    new = rows.where("c_nationkey >= 5").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return upsert.upsert(old, new, ["c_custkey"], ["c_name", "c_acctbal"], delete_missing=True).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("""select i.id, i.status from incidents i where i.id not in (select incident_id from alerts where incident_id is not null and severity = 'critical') and i.id not in (select incident_id from documents where incident_id is not null and source = 'shift_report')""")
def collectable_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "alerts").where("severity = 'critical'").select(F.col("incident_id").alias("id"))
    told = table(spark, sf_dir, "documents").where("source = 'shift_report'").select(F.col("incident_id").alias("id"))
    return upsert.collectable(table(spark, sf_dir, "incidents").select("id", "status"), active, told)


@query("""with s as (select doc_id, case when lang = 'ru' then text || '!' else text end text from documents where source is not null) select count(d.doc_id)::bigint n_stored, count(s.doc_id)::bigint n_source,
count(*) filter (d.doc_id is null)::bigint n_missing, count(*) filter (s.doc_id is null)::bigint n_extra, count(*) filter (d.doc_id is not null and s.doc_id is not null and d.text is distinct from s.text)::bigint n_different
from documents d full outer join s on d.doc_id = s.doc_id""")
def raw_hash_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    source = docs.where("source is not null").withColumn("text", F.when(F.col("lang") == "ru", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return upsert.compare_content(docs, source, "doc_id", "text")


# --- aggregations and deterministic halves of model steps --------------------------------------------


@query("select host, count(*)::bigint n, count(*) filter (severity = 'critical')::bigint n_critical, count(command_line)::bigint n_commands, count(distinct rule_id)::bigint n_rules, array_to_string(list_sort(list_distinct(list(rule_id))), ',') rules, coalesce(max(event_id), 0)::bigint last_event from alerts group by host")
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alerts").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count("command_line").alias("n_commands"), F.count_distinct("rule_id").alias("n_rules"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.coalesce(F.max("event_id"), F.lit(0).cast("bigint")).alias("last_event"),
    )


@query("select status, count(*)::bigint n, round(avg(len(hosts)), 6) mean_hosts, median(len(hosts))::double median_hosts, round(avg(confidence)::double, 6) mean_confidence from incidents group by status")
def incident_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "incidents")
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("hosts")), 6).alias("mean_hosts"), F.median(F.size("hosts")).alias("median_hosts"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("mean_confidence")
    )


@query("select event_type, sum(json_extract(props, '$.k')::bigint)::bigint tokens, round(sum(json_extract(props, '$.k')::bigint) * 3.0 / 1e6, 6) as cost, count(*)::bigint n from events group by event_type")
def json_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    out = rows.groupBy("event_type").agg(F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cost", validate.token_cost(F.col("tokens"), F.lit(3.0)))


@query(f"""select * exclude (n) from (select {_host('host')} host, id, event_code, epoch_us(ts) ts_us, row_number() over (partition by {_host('host')} order by ts desc nulls last, id desc) n from telemetry) where n = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telemetry").select(host_key(F.col("host")).alias("host"), "id", "event_code", "ts")
    return validate.latest_verdicts(rows, "host", "ts", "id").select("host", "id", "event_code", F.unix_micros("ts").alias("ts_us"))


@query("""with e as (select incident_id, list(id) ids from telemetry where incident_id is not null group by 1), c as (select incident_id, doc_id, list_filter(list_transform(regexp_extract_all(text, '\\b[0-9]+\\b'), lambda x: try_cast(x as bigint)), lambda x: x is not null) cited from documents where text is not null and incident_id is not null)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(cited, lambda x: list_contains(coalesce(ids, []), x)))), ',') valid from c left join e using (incident_id)""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and incident_id is not null")
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"\b([0-9]+)\b"), F.lit(1)), lambda x: x.try_cast("bigint"))
    # Cited ids meet the evidence as pairs: an incident's evidence is never one array.
    pairs = docs.select("incident_id", "doc_id", F.explode(F.array_distinct(cited)).alias("id"))
    found = pairs.join(table(spark, sf_dir, "telemetry").select("incident_id", "id"), ["incident_id", "id"]).groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("valid"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.col("valid").cast("array<string>"), ","), F.lit("")).alias("valid"))


@query("select id, incident_id, ((row_number() over (partition by incident_id order by id) - 1) // 5)::bigint batch from alerts where incident_id is not null")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.batch_numbers(table(spark, sf_dir, "alerts").where("incident_id is not null"), "incident_id", "id")
    return rows.select("id", "incident_id", "batch")


@query("select id, round(greatest(0, least(1, coalesce(confidence::double, 0.5) + greatest(-0.5, least(0, (priority - 50) / 100.0)))), 3)::double confidence from incidents")
def confidence_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "incidents").select("id", validate.updated_confidence(F.col("confidence"), (F.col("priority") - 50) / F.lit(100.0)).alias("confidence"))


@query("""select a.id, r.rule_id is not null known, case when a.rule_id is null or upper(trim(a.rule_id)) in ('', 'NONE', 'NULL') then 'declined' when r.rule_id is not null then 'accepted' else 'rejected' end verdict from alerts a left join detection_rules r on a.rule_name = r.rule_name and a.rule_id = r.rule_id""")
def whitelist_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = validate.whitelisted(table(spark, sf_dir, "alerts").select("id", "rule_name", "rule_id"), table(spark, sf_dir, "detection_rules"), ["rule_name", "rule_id"])
    return claims.select("id", (F.col("verdict") == "accepted").alias("known"), "verdict")


@query("""select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(distinct l_orderkey)::bigint n_orders from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("l_orderkey").alias("n_orders")
    )


@query(f"{_DETECT} select * rename (dst_peer as dst_ip) from ({_SESSIONS})")
def source_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacon sessions of the detected script-host connections, by the production window."""
    hits = _hits(spark, sf_dir).where("rule_id = 'CUR-013'")
    return _beacons(hits, ["host", "process_uid", "dst_ip", "dst_port"], "event_id", 300)
