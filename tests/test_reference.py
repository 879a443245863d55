"""The reference operators: input and result tables, and properties."""

import json
import random
import zipfile
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import parse
from siltstone.functions.event_text import event_line
from siltstone.operators import accuracy, audit, beacon, correlate, dedup, incident, rules, search, upsert, validate
from siltstone.operators.numbering import numbered
from siltstone.plans import pipeline, reference
from siltstone.session import scratch_path
from siltstone.sources import catalogues, lines
from siltstone.sources.records import parse_records, reject_counts, with_record
from siltstone.streaming import windows

T0 = datetime(2020, 5, 2, 3, 0, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# --- detection -----------------------------------------------------------------------------------

EVENTS = [
    # code, event columns, document, rules that fire
    ("1", {"process_name": "C:\\x\\powershell.exe", "parent_process": "C:\\o\\WINWORD.EXE"}, {}, {"CUR-001"}),
    ("1", {"process_name": "C:\\ProgramData\\a.exe"}, {}, {"CUR-002"}),
    ("1", {"process_name": "C:\\ProgramData\\docker-x.exe"}, {}, set()),
    ("4104", {}, {"unmapped": {"ScriptBlockText": "FromBase64String; (New-Object Net.WebClient)"}}, {"CUR-003", "CUR-004"}),
    ("1", {"command_line": "powershell -w hidden"}, {}, {"CUR-003"}),
    ("10", {}, {"process": {"file": {"path": "\\Device\\HarddiskVolume1\\lsass.exe"}}, "unmapped": {"GrantedAccess": "0x1FFFFF"}}, {"CUR-005"}),
    ("13", {}, {"reg_value": {"path": "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x"}}, {"CUR-006"}),
    ("7045", {}, {}, {"CUR-007"}),
    ("4698", {}, {"unmapped": {"TaskName": "\\evil"}}, {"CUR-008"}),
    ("4698", {}, {"unmapped": {"TaskName": "\\OneDrive Standalone Update Task-1"}}, set()),
    ("4720", {}, {}, {"CUR-009"}),
    ("4732", {}, {}, {"CUR-010"}),
    ("5857", {}, {}, {"CUR-011"}),
    ("1", {"parent_process": "C:\\w\\wmiprvse.exe", "process_name": "c:\\a\\b.exe"}, {}, {"CUR-011"}),
    ("5140", {}, {"unmapped": {"ShareName": "\\\\*\\c$"}}, {"CUR-012"}),
    ("3", {"process_name": "c:\\w\\cmd.exe", "dst_ip": "10.0.0.9"}, {"dst_endpoint": {"port": 8080}}, {"CUR-013"}),
    ("3", {"process_name": "c:\\w\\cmd.exe", "dst_ip": "10.0.0.9"}, {"dst_endpoint": {"port": 445}}, set()),
    ("3", {"dst_ip": "10.0.0.9"}, {"dst_endpoint": {"port": "5985"}}, {"CUR-021"}),
    ("11", {"file_path": "C:\\Users\\a\\Start Menu\\Programs\\Startup\\x.lnk"}, {}, {"CUR-014"}),
    ("1", {"process_name": "c:\\w\\WHOAMI.exe"}, {}, {"CUR-015"}),
    ("7", {}, {"module": {"file": {"path": "c:\\users\\bob\\temp\\x.dll"}}}, {"CUR-016"}),
    ("4624", {"src_ip": "10.1.1.1"}, {"unmapped": {"LogonType": "10"}}, {"CUR-017"}),
    ("4624", {"src_ip": "172.18.39.2"}, {"unmapped": {"LogonType": "10"}}, set()),
    ("1149", {"raw": '{"Message":"x Source Network Address: 10.2.2.2"}'}, {}, {"CUR-017"}),
    ("4769", {}, {"unmapped": {"TicketEncryptionType": "0x17"}}, {"CUR-018"}),
    ("99", {"file_path": "c:\\x\u202ecod.scr"}, {}, {"CUR-019"}),
    ("1", {"process_name": "c:\\w\\mshta.exe", "command_line": "mshta.exe http://x"}, {}, {"CUR-020"}),
    ("1", {"process_name": "c:\\w\\wsmprovhost.exe"}, {}, {"CUR-021"}),
    ("11", {"file_path": "C:\\Windows\\Temp\\a.ZIP"}, {}, {"CUR-022"}),
    ("11", {"file_path": "C:\\ProgramData\\Microsoft\\Windows\\a.zip"}, {}, set()),
    (None, {}, None, set()),
    ("1", {}, "broken", set()),
]
COLUMNS = ["host", "user_name", "process_name", "parent_process", "command_line", "file_path", "src_ip", "dst_ip", "raw"]


def event_rows(spark, events):
    schema = "id bigint, ts timestamp, event_code string, ocsf string, " + ", ".join(f"{c} string" for c in COLUMNS)
    rows = []
    for i, (code, cols, doc, _) in enumerate(events):
        text = doc if doc is None or isinstance(doc, str) else json.dumps(doc) if i % 2 else json.dumps(json.dumps(doc))
        rows.append((i, at(i), code, text, *(cols.get(c) for c in COLUMNS)))
    return spark.createDataFrame(rows, schema)


def test_every_rule(spark):
    hits = rules.detect(event_rows(spark, EVENTS)).select("event_id", "rule_id").collect()
    got = {i: {h["rule_id"] for h in hits if h["event_id"] == i} for i in range(len(EVENTS))}
    assert got == {i: e[3] for i, e in enumerate(EVENTS)}
    assert {r for e in EVENTS for r in e[3]} == {r.rule_id for r in rules.RULES}
    said = {(r["event_id"], r["severity"], r["rule_name"], tuple(r["technique_ids"])) for r in rules.detect(event_rows(spark, EVENTS)).where("rule_id in ('CUR-011', 'CUR-021')").collect()}
    places = [i for i, e in enumerate(EVENTS) if e[3] & {"CUR-011", "CUR-021"}]
    assert said == {
        (places[0], "medium", "WMI Activity Provider Operation", ("T1047",)), (places[1], "medium", "Process Spawned by WMI Provider (wmiprvse.exe)", ("T1047",)),
        (places[2], "medium", "Network Connection to WinRM Port (5985/5986)", ("T1021.006", "T1059.001")), (places[3], "high", "WinRM Remote Management Host Process Spawned", ("T1021.006",)),
    }
    scanned = {h["rule_id"] for h in rules.detect(event_rows(spark, EVENTS), codes=rules.CANDIDATE_CODES).collect()}
    assert scanned == {r.rule_id for r in rules.RULES} - {"CUR-019"}  # its event has a code that is not scanned
    numbered = rules.number_alerts(rules.detect(event_rows(spark, EVENTS))).orderBy("ts", "rule_id").collect()
    assert [r["id"] for r in numbered] == list(range(1, len(hits) + 1))


# --- dedup ---------------------------------------------------------------------------------------

ALERT = "id bigint, rule_id string, host string, user_norm string, process_uid string, ts timestamp, command_line string"


def greedy(rows):
    """The greedy rule over all rows at once, with set similarity by the same signature."""
    import hashlib
    import re

    from siltstone.functions.minhash import MULTIPLIERS, OFFSETS, PRIME, TOKEN

    def words(c):
        return {t.lower() for t in re.findall(TOKEN, c or "") if len(t) > 1}

    def sig(ws):
        hs = [int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") for w in ws]
        return [min((a * h + b) % PRIME for h in hs) for a, b in zip(MULTIPLIERS, OFFSETS)]

    seen, held, out = {}, [], {}
    for i, r, h, u, p, t, c in sorted(rows, key=lambda x: (x[5], x[0])):
        key = (r, h or "", u or "", p or "", int(t.timestamp()) // 60)
        owner = seen.get(key)
        ws = words(c)
        if owner is None and len(ws) >= 3:
            s = sig(ws)
            for t2, i2, g2, s2 in held:
                if g2 == (r, h, u) and (t - t2).total_seconds() <= 300 and sum(a == b for a, b in zip(s, s2)) / 64 >= 0.9:
                    owner = i2
                    break
        if owner is None:
            seen[key] = i
            if len(ws) >= 3:
                held.append((t, i, (r, h, u), sig(ws)))
        out[i] = owner
    return out


def test_greedy_equals_global(spark):
    r = random.Random(4)
    base = [f"cmd.exe /c run --alpha {k} --beta one two three four five six seven eight nine ten eleven twelve thirteen fourteen" for k in ("a1", "b2")]
    rows = [(i, r.choice(["R1", "R2"]), r.choice(["H", None]), r.choice(["u", None]), r.choice(["p", "q", None]), at(r.choice(range(0, 2000, 20))), r.choice([*base, base[0] + " x9", "ab", None, ""])) for i in range(150)]
    got = {x["id"]: x["canonical_id"] for x in dedup.mark_greedy(spark.createDataFrame(rows, ALERT)).collect()}
    assert got == greedy(rows)
    assert dedup.mark_greedy(spark.createDataFrame([], ALERT)).count() == 0


def test_exact_and_near_duplicates(spark):
    line = "cmd.exe /c powershell -enc " + " ".join(f"word{k}" for k in range(80)) + " 10.0.0.%d"
    rows = [(1, "R", "H", "u", "p", at(0), "x"), (2, "R", "H", "u", "p", at(20), "x"), (10, "R", "H", "u", "p1", at(600), line % 1), (11, "R", "H", "u", "p2", at(720), line % 2), (12, "R", "H", "u", "p3", at(1021), line % 1)]
    got = {x["id"]: x["canonical_id"] for x in dedup.mark_greedy(spark.createDataFrame(rows, ALERT)).collect()}
    assert got == {1: None, 2: 1, 10: None, 11: 10, 12: None}  # 12: 421 s after 10, and 11 is no canonical one
    keyed = spark.createDataFrame(rows, ALERT).withColumn("dedup_key", dedup.exact_key(*(F.col(c) for c in ("rule_id", "host", "user_norm", "process_uid", "ts"))))
    assert {x["id"]: x["canonical_id"] for x in dedup.mark_exact(keyed).collect()} == {1: None, 2: 1, 10: None, 11: None, 12: None}


def test_pipeline_marks_near_duplicates(spark):
    line = "c:\\programdata\\a.exe " + " ".join(f"word{k}" for k in range(80)) + " 10.0.0.%d"
    start = lambda k, path: ("1", {"host": "H", "process_name": path, "command_line": line % k}, {}, set())
    events = event_rows(spark, [start(1, "c:\\programdata\\a.exe"), start(2, "c:\\programdata\\a.exe")]).withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, id * 120)"))
    marked = pipeline.marked_alerts(rules.detect(events))
    assert [(r["id"], r["event_id"], r["is_duplicate"], r["canonical_id"]) for r in marked.orderBy("id").collect()] == [(1, 0, False, None), (2, 1, True, 1)]
    assert {tuple(r) for r in correlate.correlate(marked).collect()} == {(1, 1), (2, 1)}  # no user, process or address in common
    assert [r["is_duplicate"] for r in pipeline.exact_alerts(rules.detect(events)).collect()] == [False, False]


# --- correlation ---------------------------------------------------------------------------------

ITEM = "id bigint, rule_id string, ts timestamp, host string, user_norm string, process_uid string, file_path string, src_ip string, dst_ip string, is_duplicate boolean, canonical_id bigint"


def clusters(spark, rows, **mode):
    out = {}
    for r in correlate.correlate(spark.createDataFrame(rows, ITEM), **mode).collect():
        out.setdefault(r["component"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def all_pairs(rows, documented):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def own(r):
        return r[1] == "CUR-021" and r[4] is not None and r[4].endswith("$") and r[4].rstrip("$").upper() == r[3]

    for a in rows:
        for b in rows:
            dt = (b[2] - a[2]).total_seconds()
            if a[0] == b[0] or dt < 0:
                continue
            same = lambda k: a[k] is not None and a[k] == b[k]  # noqa: E731, B023
            ips = {x for x in a[7:9] if x} & {x for x in b[7:9] if x}
            tell = a[4] is not None and not a[4].endswith("$") and a[4] != "system"
            joined = (same(5) and dt <= 900) or (tell and same(4) and dt <= 1800) or (ips and dt <= 1800) or (same(3) and dt <= 120 and (own(a) or own(b)))
            joined = joined or ((same(6) and dt <= 3600) or (same(3) and dt <= 1800) if documented else (same(6) and 1800 < dt <= 3600))
            if joined:
                parent[find(a[0])] = find(b[0])
    out = {}
    for r in rows:
        out.setdefault(find(r[0]), set()).add(r[0])
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edges_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    pick = lambda *x: r.choice([None, None, *x])
    rows = [
        (i, r.choice(["CUR-001", "CUR-021"]), at(r.choice(range(0, 40_000, 60))), pick("H1", "H2", "H3"), pick("ann", "bob", "h1$", "system"), pick("p1", "p2", "p3", "p4"), pick("f1", "f2", "f3"), pick("10.0.0.1", "10.0.0.2"), pick("10.0.0.3", "10.0.0.1"), False, None)
        for i in range(60)
    ]
    assert clusters(spark, rows) == all_pairs(rows, False)
    if seed == 1:
        assert clusters(spark, rows, documented=True) == all_pairs(rows, True)


def test_windows_and_duplicates(spark):
    def row(i, t, host=None, user=None, uid=None, path=None, dup=None, rule="CUR-001"):
        return (i, rule, at(t), host, user, uid, path, None, None, dup is not None, dup)

    rows = [row(1, 0, "UTICA", "pbeesly", "X"), row(2, 300, "UTICA", "pbeesly", "X"), row(3, 600, "UTICA", "pbeesly", "Y"), row(4, 14400, "SCRANTON", "dschrute", "Z"), row(5, 9, dup=4)]
    assert clusters(spark, rows) == [[1, 2, 3], [4, 5]]
    assert clusters(spark, [row(1, 0, "A"), row(2, 60, "A")]) == [[1], [2]]
    assert clusters(spark, [row(1, 0, path="f"), row(2, 1800, path="f")]) == [[1], [2]]
    assert clusters(spark, [row(1, 0, path="f"), row(2, 1801, path="f")]) == [[1, 2]]
    machine = lambda t: [row(1, 0, "PC"), row(2, t, "PC", "pc$", rule="CUR-021")]
    assert clusters(spark, machine(120)) == [[1, 2]] and clusters(spark, machine(121)) == [[1], [2]]
    assert clusters(spark, []) == []


def test_long_chain(spark):
    nodes = spark.range(300)
    edges = nodes.where("id < 299").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in correlate.connected_components(nodes, edges).collect()} == {0}


# --- incidents -----------------------------------------------------------------------------------


def test_priority(spark):
    def score(ids, hosts):
        tactics = {r.rule_id: r.tactic for r in rules.RULES}
        row = spark.createDataFrame([(ids, hosts, sorted({tactics[i] for i in ids}))], "r array<string>, h array<string>, t array<string>")
        return row.select(incident.priority(F.col("r"), F.col("h"), F.col("t"))[0]).first()[0]

    assert score(["CUR-003", "CUR-021"], ["A"]) == 25
    assert score(["CUR-005"], ["A", "B"]) == 55
    assert score([r.rule_id for r in rules.RULES], ["A", "B"]) == 100
    assert score(["CUR-015"], []) == 0


def test_beacons(spark):
    rows = [("h", "ip", at(10 * k), k) for k in range(12)] + [("h", "x", at(0), 99), (None, None, at(5), 98), ("h", "ip", None, 97)]
    got = {(r["h"], r["d"]): r for r in beacon.beacon_sessions(spark.createDataFrame(rows, "h string, d string, t timestamp, i bigint"), ["h", "d"], "t", "i").collect()}
    b = got["h", "ip"]
    assert (b["n"], b["mean_gap"], b["std_gap"], b["is_beaconing"], b["severity"], b["first_id"]) == (12, 10.0, 0.0, True, "high", 0)
    assert (got["h", "x"]["is_regular"], got["h", "x"]["severity"]) == (False, "medium") and (None, None) in got


def test_pipeline_gathers_beacons(spark):
    connect = ("3", {"host": "H", "process_name": "c:\\w\\cmd.exe", "dst_ip": "10.0.0.9"}, {"dst_endpoint": {"port": 8080}}, set())
    late = ("3", {**connect[1], "dst_ip": "10.0.0.8"}, connect[2], set())
    rows = event_rows(spark, [connect] * 12 + [late] * 3 + [("7045", {"host": "H"}, {}, set()), connect])
    events = rows.withColumn("ts", F.when(F.col("id") < 16, F.col("ts") + F.make_dt_interval(secs=F.col("id") * 9)))
    got = pipeline.marked_alerts(rules.detect(events)).orderBy("event_id").select("event_id", "rule_id", "severity", "dst_ip").collect()
    # Twelve regular connections are one alert, three to another peer one, the last has no time and stays.
    assert [tuple(r) for r in got] == [(0, "CUR-013", "high", "10.0.0.9"), (12, "CUR-013", "medium", "10.0.0.8"), (15, "CUR-007", "high", None), (16, "CUR-013", "medium", "10.0.0.9")]


FIELDS = "id bigint, ts timestamp, host_key string, user_norm string, own_uid string, uids array<string>, parent_uids array<string>, code string"


def evidence_tiers(spark, events, alerting, **limits):
    tiers = {}
    rows = incident.evidence(spark.createDataFrame(events, FIELDS), spark.createDataFrame(alerting, "event_id bigint, incident bigint"), "incident", **limits)
    for r in rows.collect():
        tiers.setdefault(r["tier"], set()).add(r["id"])
    return tiers


def test_evidence_budget(spark):
    events = [(i, at(i), "H", "u", "P" if i < 40 else None, ["P"] if i < 40 else [], ["P"] if i > 90 else [], "4656" if i % 2 else "1") for i in range(100)]
    tiers = evidence_tiers(spark, events, [(5, 1), (5, 1), (60, 1), (None, 1)], cap=50, user_cap=12)
    assert tiers[0] == {5, 60} and tiers[1] == set(range(40)) - {5}
    # The user limit counts candidates by time before the tiers are compared; what is left goes by order.
    assert sum(map(len, tiers.values())) == 50 and tiers.get(2, set()) == set() and tiers[3] == set(range(91, 100))


def test_evidence_windows_and_uids(spark):
    def event(i, t, user="u", own=None, uids=(), parents=()):
        return (i, at(t), "H", user, own, list(uids), list(parents), "1")

    events = [event(1, 5000, own="P", uids=["P"]), event(2, 4940, None, uids=["Q", "P"]), event(3, 4939, None, uids=["P"]), event(4, 4970), event(5, 4969), event(6, 90_000, None, parents=["X", "P"]), event(7, 5001, "system")]
    assert evidence_tiers(spark, events, [(1, 1)]) == {0: {1}, 1: {2}, 2: {4}, 3: {6}}
    # A built-in account gathers nothing, and an incident at midnight reaches into the hour before.
    assert evidence_tiers(spark, [event(1, 0, "system"), event(2, 1, "system")], [(1, 1)]) == {0: {1}}
    assert evidence_tiers(spark, [event(1, 3600, own="P", uids=["P"]), event(2, 3541, None, uids=["P"])], [(1, 1)]) == {0: {1}, 1: {2}}
    assert evidence_tiers(spark, events, []) == {}


def test_entities(spark):
    row = {"host": "h.x", "user_name": "Ann", "process_name": "C:\\a.exe", "parent_process": "c:\\A.EXE", "file_path": None, "src_ip": "0.0.0.0", "dst_ip": "10.0.0.1"}
    df = spark.createDataFrame([(7, 1, at(0), *row.values())], "incident bigint, id bigint, ts timestamp, " + ", ".join(f"{k} string" for k in row))
    assert {(r["kind"], r["value"]) for r in incident.entities(df, "incident").collect()} == {("host", "H"), ("user", "ann"), ("process", "c:\\a.exe"), ("ip", "10.0.0.1")}
    assert {r["relation"] for r in incident.entity_edges(df, "incident").collect()} == {"executed", "connected_to", "authenticated_as"}


def test_entities_from_the_document(spark):
    doc = {"device": {"hostname": "pc1.x"}, "actor": {"user": {"name": "bob"}}, "process": {"file": {"path": "C:\\B.exe"}, "parent_process": {"file": {"path": "c:\\p.exe"}}}, "dst_endpoint": {"ip": "10.9.9.9"}, "unmapped": {"TargetFilename": "c:\\t.txt"}}
    columns = ["host", "user_name", "process_name", "parent_process", "file_path", "src_ip", "dst_ip"]
    df = spark.createDataFrame([(7, 1, at(0), *[None] * 7, json.dumps(doc)), (7, 2, at(9), *[None] * 7, "broken")], "incident bigint, id bigint, ts timestamp, " + ", ".join(f"{c} string" for c in columns) + ", ocsf string")
    things = incident.entities(df, "incident")
    assert {(r["kind"], r["value"]) for r in things.collect()} == {("host", "PC1"), ("user", "bob"), ("process", "c:\\b.exe"), ("process", "c:\\p.exe"), ("file", "c:\\t.txt"), ("ip", "10.9.9.9")}
    edges = incident.entity_edges(df, "incident")
    assert {(r["relation"], r["n_events"]) for r in edges.collect()} == {("executed", 1), ("spawned", 1), ("wrote", 1), ("connected_to", 1), ("authenticated_as", 1)}
    assert {(r["relation"], r["id"]) for r in incident.entity_edge_events(df, "incident").collect()} == {(r["relation"], 1) for r in edges.collect()}
    a = {tuple(r) for r in incident.resolved_edges(edges, things, "incident").select("relation", "src_id", "dst_id").collect()}
    assert a == {tuple(r) for r in edges.select("relation", "src_id", "dst_id").collect()} and len(a) == 5
    assert incident.resolved_edges(edges, things.where("kind <> 'user'"), "incident").count() == 3


def test_similar_pairs(spark):
    rows = [(1, "R", "H", None, "p", at(0), "one two three four"), (2, "R", "H", None, "p", at(300), "one two three four"), (3, "R", "H", None, "p", at(301), "five six seven"), (4, "R", "H", "u", "p", at(1), "one two three four"), (5, None, "H", None, "p", at(1), "x y"), (6, "R", "H", None, "p", at(0), None)]
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in dedup.similar_pairs(spark.createDataFrame(rows, ALERT)).collect()}
    assert got[1, 2] == 1.0 and set(got) == {(1, 2), (2, 3)} and got[2, 3] < 0.5


# --- search --------------------------------------------------------------------------------------


def test_filters(spark):
    events = event_rows(spark, EVENTS).withColumn("incident_id", F.lit(1).cast("bigint"))
    count = lambda f, n=50: search.filter_search(events, f, n).count()
    assert count({}) == len(EVENTS) and count({}, 25) == 25
    assert count({"event_codes": ["7045", "3"]}) == 4
    assert count({"process_names": ["CMD.exe"]}) == 2
    assert count({"command_line_contains": ["mshta", "HTTP"]}) == 1
    assert count({"time_after": "2020-05-02 03:00:10", "time_before": "2020-05-02 03:00:12"}) == 3
    assert count({"incident_id": 2}) == 0
    with pytest.raises(ValueError):
        search.filter_predicate({"hosts": ["SCRANTON; DROP TABLE events--"]})
    with pytest.raises(ValueError):
        search.filter_predicate(["x"])
    assert search.filter_search(events, {"command_line_contains": ["update"]}, guard=False).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id bigint, rank int")
    got = [(r["id"], round(r["score"], 6)) for r in search.reciprocal_rank_fusion(a, b, "id", 5).orderBy("rank").collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6)), (3, round(1 / 62, 6))]


def test_keywords_and_enrichment(spark):
    docs = spark.createDataFrame([(1, "staged archives uploaded"), (2, "archive"), (3, None), (4, "nothing here")], "id bigint, text string")
    assert [r["id"] for r in search.keyword_rank(docs, "id", "text", "the staging of archives").orderBy("rank").collect()] == [1, 2]
    one = spark.range(1)
    none = F.lit(None).cast("string")
    terms = search.context_terms(F.lit("a.exe"), F.lit("x" * 200), none, F.lit(5985), F.lit("4688"), F.lit(""), "corp.local")
    assert one.select(terms).first()[0] == ["a.exe", "x" * 120, "WinRM Windows Remote Management remote services PowerShell remoting", "process creation"]
    assert one.select(search.context_terms(none, none, none, F.lit(50000), F.lit("?"), none, "corp.local")).first()[0] == ["RPC DCOM"]
    said = search.enriched_query(F.lit("Logon 10:20:30 from a.corp.local 10.0.0.1:80  now"), F.array(F.lit("x"), F.lit("x"), F.lit("network connection")), "corp.local")
    assert one.select(said).first()[0] == "Logon from now  x network connection"
    gone = search.enriched_query(F.lit("Remove-Item done"), F.array(F.lit("process creation"), F.lit("y")), "corp.local")
    assert one.select(gone).first()[0] == "Remove-Item done indicator removal file deletion anti-forensics evidence destruction secure delete y"
    assert one.select(search.enriched_query(F.lit("q"), F.lit(None).cast("array<string>"), "corp.local")).first()[0] == "q"
    assert one.select(search.cleaned_query(F.lit("on UTICA and utica.corp.local"), "corp.local", ("utica",))).first()[0] == "on and"
    assert one.select(search.query_text(F.lit("q")), search.passage_text(F.lit("n"), F.lit("d"))).first()[:] == ("Represent this sentence for searching relevant passages: q", "n. d")


def test_every_fiftieth_row_is_a_query(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], f"alpha w{i % 7} w{i % 11}") for i in range(160)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, text string").select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, text string").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for x in reference.vector_topk(spark, str(tmp_path)).orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert set(got) == {q for q in (0, 50, 100, 150) if any(rows[q][1])}
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, text string")
    for q in got:
        alone = search.vector_topk(items, "vec_id", "embedding", rows[q][1]).orderBy("rank").collect()
        assert got[q] == [x["vec_id"] for x in alone]
    words = search.keyword_rank_all(items, "vec_id", "text", items.where("vec_id = 50").selectExpr("vec_id query_id", "text")).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in words] == [(x["vec_id"], x["score"]) for x in search.keyword_rank(items, "vec_id", "text", rows[50][2]).orderBy("rank").collect()]
    fused = reference.hybrid_rrf(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {tuple(x) for x in fused} == {(q, 20) for q in (0, 50, 100, 150)}


def _shuffled(node) -> int:
    """Rows written to shuffles by a plan that ran."""
    kind, metrics, below = node.getClass().getSimpleName(), node.metrics(), node.children()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(_shuffled(below.apply(i)) for i in range(below.size()))


def test_keyword_search_shuffles_no_pairs(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(400)], "id bigint, text string")
    asked = docs.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    found = search.keyword_rank_all(docs, "id", "text", asked, pool=3)
    assert {(x["query_id"], x["id"], x["rank"], x["score"]) for x in found.collect()} == {(q, k, k + 1, 0.4) for q in range(0, 400, 4) for k in range(3)}
    assert 0 < _shuffled(found._jdf.queryExecution().executedPlan()) < 10_000  # of 40,000 pairs


@pytest.mark.parametrize("block", [48_000_000, 900])
def test_keyword_search_of_odd_rows(spark, block):
    r = random.Random(11)
    texts = [None, "", "...", "the of", *(" ".join(r.choices(["alpha", "beta", "gamma", "delta", "omega", "the", f"w{i % 9}"], k=r.choice([1, 2, 3, 40]))) for i in range(120))]
    rows = [(r.choice([None, *"abcdefghijklmnopqrstuvwxyz"]), x) for x in texts]
    docs = spark.createDataFrame(rows, "id string, text string")
    asked = [(k % 17, x) for k, (_, x) in enumerate(rows) if k % 3 == 0]
    got = search.keyword_rank_all(docs, "id", "text", spark.createDataFrame(asked, "query_id int, text string"), pool=5, block=block).collect()
    want = {}
    for q, x in asked:
        known = {w for w in (x or "").replace(".", "").split() if w not in search.STOP_WORDS}
        for k, y in rows:
            if held := sum(w in known for w in (y or "").split()):
                want.setdefault(q, []).append((-held, k is None, k or ""))
    want = [(q, k or None, round(-h * 0.1, 9), rank) for q, own in want.items() for rank, (h, _, k) in enumerate(sorted(own)[:5], 1)]
    assert sorted(map(str, ((x["query_id"], x["id"], x["score"], x["rank"]) for x in got))) == sorted(map(str, want))


def test_best_held_leaves_nothing_out():
    r = random.Random(5)
    given = [[r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 3, 9, 60]))] for _ in range(200)]
    asked = [r.sample("abcdefghijklmnopqrst", r.choice([1, 2, 8])) for _ in range(40)] + [["zz"]]
    ids = [r.randrange(90) for _ in given]
    got = {}
    batches = [pa.array([" ".join(x) for x in given[:70]]), pa.array([" ".join(x) for x in given[70:]])]
    for found in search._best_held([pa.array([" ".join(x) for x in asked])], batches, pa.array(ids), 6, head=8, most=500):
        for q, d, held in zip(*(x.tolist() for x in found)):
            assert held == sum(w in asked[q] for w in given[d])
            got.setdefault(q, []).append((-held, ids[d]))
    for q, words in enumerate(asked):
        scores = [(-sum(w in words for w in x), i) for x, i in zip(given, ids)]
        assert got.get(q, []) == sorted(s for s in scores if s[0])[:6]


# --- audit, accuracy, sinks ------------------------------------------------------------------------


def test_audit(spark):
    path = scratch_path(spark, "audit")
    digest = audit.append(spark, path, "pipeline", "x", {"b": 1, "a": 2}, T0)
    assert digest == "8a96fb93efb58c634568df4d47f300d24a9933e0ddf97e03957ec2f228dcfd0e"
    for k in range(3):
        audit.append(spark, path, "ann", "é", None if k else {"n": [1, "ü"]}, at(k + 0.000123))
    log = spark.read.parquet(path)
    assert tuple(audit.verify(log).first()) == (True, 4, None)
    tampered = log.withColumn("action", F.when(F.col("id") == 3, "y").otherwise(F.col("action")))
    assert tuple(audit.verify(tampered).first()) == (False, 4, 3)
    with pytest.raises(TypeError):
        audit.canonical_json({"a": [1.5]})


def test_accuracy(spark):
    rec = spark.createDataFrame([("T1",), ("T2.001",), ("T3",), ("T9",), ("T22",)], "id string")
    truth = spark.createDataFrame([("T1",), ("T2",), ("T3.004",), ("T3.001",), ("T5",)], "id string")
    assert {r["id"]: (r["match"], r["truth_id"]) for r in accuracy.match_techniques(rec, truth).collect()} == {
        "T1": ("exact", "T1"), "T2.001": ("related", "T2"), "T3": ("related", "T3.001"), "T9": ("beyond", None), "T22": ("beyond", None),
    }
    row = accuracy.accuracy(rec, truth).first()
    assert (row["precision"], row["recall"], row["n_truth"]) == (0.6, 0.6, 5)
    assert {r["id"] for r in accuracy.missed(rec, truth).collect()} == {"T3.004", "T5"}
    old = spark.createDataFrame([("T1002", "T1560"), ("T1022", "T1560")], "old string, new string")
    shipped = spark.createDataFrame([("T1002",), ("T1022",), ("T1",)], "t string")
    assert {r["id"]: r["shipped"] for r in accuracy.resolve_ids(shipped, "t", old).collect()} == {"T1560": ["T1002", "T1022"], "T1": ["T1"]}


def test_sinks(spark):
    path = scratch_path(spark, "table")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "uid string, id int")
    assert upsert.idempotent_append(rows, path, "uid", ["id"]) == 3
    assert upsert.idempotent_append(rows.where("uid is not null"), path, "uid", ["id"]) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3, 4]
    parts = scratch_path(spark, "parts")
    upsert.replace_partitions(spark.createDataFrame([("x", 1), ("y", 2)], "d string, v int"), parts, ["d"])
    upsert.replace_partitions(spark.createDataFrame([("y", 3)], "d string, v int"), parts, ["d"])
    assert {(r["d"], r["v"]) for r in spark.read.parquet(parts).collect()} == {("x", 1), ("y", 3)}
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    got = {r["k"]: (r["v"], r["change"]) for r in upsert.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "keep"), 2: ("c", "update"), 3: (None, "same"), 4: ("d", "insert")}
    with pytest.raises(RuntimeError):
        upsert.guard_rebuild(rows)
    upsert.guard_rebuild(rows, force=True)
    upsert.guard_rebuild(rows.limit(0))


# --- model steps ---------------------------------------------------------------------------------


def test_validation(spark):
    one = spark.createDataFrame([([3, 1, 9], [1, 2, 3])], "c array<bigint>, a array<bigint>")
    assert one.select(validate.valid_citations(F.col("c"), F.col("a"))).first()[0] == [3, 1]
    update = lambda o, c: spark.range(1).select(validate.updated_confidence(F.lit(o).cast("double"), F.lit(c).cast("double"))).first()[0]
    assert [update(0.9, -0.2), update(0.3, -0.9), update(None, 0.4), update(0.2, -0.5)] == [0.7, 0.0, 0.5, 0.0]
    claims = spark.createDataFrame([(1, "T1"), (1, "none"), (2, "T1"), (2, None)], "seq int, id string")
    verdicts = [(r["seq"], r["id"], r["verdict"]) for r in validate.whitelisted(claims, spark.createDataFrame([(1, "T1")], "seq int, id string"), ["seq", "id"]).collect()]
    assert sorted(verdicts, key=str) == sorted([(1, "T1", "accepted"), (1, "none", "declined"), (2, "T1", "rejected"), (2, None, "declined")], key=str)
    sentences = spark.createDataFrame([(1, s) for s in (3, 5, 9, 11, 20, 21)], "g int, seq int")
    assert [r["seq"] for r in validate.renumbered(sentences, "g", "seq").orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r["batch"] for r in validate.batch_numbers(sentences, "g", "seq").orderBy("seq").collect()] == [0, 0, 0, 0, 0, 1]
    asked = validate.with_model(spark.createDataFrame([("a",), ("b",)], "p string"), lambda ps: [p.upper() for p in ps], "p")
    assert [r["answer"] for r in asked.orderBy("p").collect()] == ["A", "B"]


def test_citations_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, 9), (1, 1234567), (1, 9999999999)], "incident_id bigint, id bigint").write.parquet(str(tmp_path / "telemetry.parquet"))
    text = "events 9, 1234567, 9999999999, 7654321 and 123456789012345678901234567890"
    spark.createDataFrame([(5, 1, text)], "doc_id bigint, incident_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in reference.citation_validate(spark, str(tmp_path)).collect()] == [(5, "9,1234567,9999999999")]


@pytest.mark.parametrize("text,wanted", [
    ('{"sentences":[{"s":1},{"s":2},{"s":', [{"s": 1}, {"s": 2}]), ('```json\n[{"p":"C:\\Windows\\x"}]\n```', [{"p": "C:\\Windows\\x"}]), ('{"a":{"b":1}}', [{"a": {"b": 1}}]), ("no json", []), (None, []),
])
def test_repair(text, wanted):
    assert validate.repair_json(text) == wanted


def test_repaired_sentences(spark):
    rows = spark.createDataFrame([(1, '[{"b":1,"a":2},{"c":3},{'), (2, None)], "id bigint, answer string")
    assert [tuple(r) for r in validate.repaired_sentences(rows, "id", "answer").collect()] == [(1, 1, '{"a": 2, "b": 1}'), (1, 2, '{"c": 3}')]


# --- sources -------------------------------------------------------------------------------------


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("a.json", '{"x":1}\n\n{"x":2}\r\n')
        z.writestr("b.json", b'\xff{"y":1}')
    got = {r["uid"]: r["value"] for r in lines.read_lines(spark, f"{tmp_path}/*.zip", "day").collect()}
    assert got == {"day/a.json:1": '{"x":1}', "day/a.json:3": '{"x":2}', "day/b.json:1": '\ufffd{"y":1}'}
    digest = lines.file_digest(str(tmp_path / "set.zip"))
    assert lines.pinned_file(str(tmp_path / "set.zip"), digest)
    with pytest.raises(ValueError):
        lines.pinned_file(str(tmp_path / "set.zip"), "0" * 64)
    assert [tuple(r)[1:] for r in lines.checked_files(spark, str(tmp_path), {"set.zip": digest}).collect()] == [(digest, True)]


def test_catalogues(spark, tmp_path):
    steps = spark.createDataFrame([("1.A", "T1059.001 then T1059.001, T1105 and XT1105"), ("1.B", None)], "step string, text string")
    assert [(r["step"], r["place"], r["technique_id"]) for r in catalogues.ground_truth(steps, "d", "step", "text").collect()] == [("1.A", 0, "T1059.001"), ("1.A", 1, "T1105")]
    ref = lambda i: [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": i}]
    phases = [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}]
    bundle = {"objects": [
        {"type": "attack-pattern", "name": "A", "description": "x (Citation: Y)", "external_references": ref("T1"), "kill_chain_phases": phases},
        {"type": "attack-pattern", "name": "B", "revoked": True, "external_references": ref("T2")}, {"type": "malware", "name": "C"},
        {"type": "attack-pattern", "name": "D", "x_mitre_deprecated": True, "external_references": ref("T4")}, {"type": "attack-pattern", "name": "E"},
    ]}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    rows = catalogues.techniques(spark, str(tmp_path / "bundle.json"))
    assert [tuple(r) for r in rows.collect()] == [("T1", "A", "x", ["execution"])]
    assert catalogues.duplicates(rows.union(rows), "id").count() == 1
    bundle["objects"].append({**bundle["objects"][0], "name": "again"})
    (tmp_path / "twice.json").write_text(json.dumps(bundle))
    with pytest.raises(ValueError, match="T1 occurs 2 times"):
        catalogues.techniques(spark, str(tmp_path / "twice.json"))


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = [("A1", "s", 0), ("A2", "s", 1), ("B2", "s", 2), ("A3", "", "1.5"), ("B3", "s", 3), ("B5", "inline", "T1105 only")]
    by_row = {}
    for ref, kind, value in cells:
        cell = f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>' if kind == "inline" else f'<c r="{ref}"{" t=" + chr(34) + "s" + chr(34) if kind else ""}><v>{value}</v></c>'
        by_row.setdefault(ref[1:], []).append(cell)
    sheet = f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{k}">{"".join(v)}</row>' for k, v in by_row.items()) + '<row r="6"><c r="A6"/></row></sheetData></worksheet>'
    strings = f"<sst {ns}>" + "".join(f"<si>{t}</si>" for t in ("<t>Plan</t>", "<t>Step</t>", "<t>Detail</t>", "<r><t>uses T1059</t></r><r><t>.001</t></r>")) + "</sst>"
    with zipfile.ZipFile(tmp_path / "plan.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Day 1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    steps = catalogues.steps_of_sheet(spark, str(tmp_path / "plan.xlsx"), "Step", "Detail")
    assert [tuple(r) for r in steps.collect()] == [("1.5", "uses T1059.001"), (None, "T1105 only")]
    assert {r["technique_id"] for r in catalogues.ground_truth(steps, "d", "step", "text").collect()} == {"T1059.001", "T1105"}
    with pytest.raises(KeyError):
        list(catalogues.sheet_rows(str(tmp_path / "plan.xlsx"), "Day 2"))
    with pytest.raises(ValueError):
        catalogues.steps_of_sheet(spark, str(tmp_path / "plan.xlsx"), "Step", "nothing")


def test_records(spark):
    flat = {"Channel": "Microsoft-Windows-Sysmon/Operational", "EventID": 3, "UtcTime": "2024-02-05 12:00:00.5", "EventTime": "2024-02-05 08:00:00", "Hostname": "h", "Image": "C:\\a\\b.exe", "ProcessId": "0x1f", "DestinationPort": "99999", "DestinationIp": "10.0.0.1", "RuleName": "-", "User": "D\\ann", "SeverityValue": 4}
    nested = {"@timestamp": "2024-02-05T12:00:00Z", "winlog": {"event_id": 4720, "channel": "Security", "event_data": {"SubjectUserName": "bob", "SubjectDomainName": "D"}}, "host": {"name": "g"}}
    listed = {"Event": {"System": {"Provider": {"Name": "Security"}, "EventID": 4663, "Computer": "k", "TimeCreated": {"SystemTime": "2024-02-05T12:00:00Z"}}, "EventData": {"Data": [{"Name": "ObjectType", "Value": "Key"}, {"Name": "ObjectName", "Value": "r1"}, {"Name": "ObjectName", "Value": "r2"}]}}}
    single = {"Event": {"System": {"Provider": {"Name": "System"}, "EventID": 1}, "EventData": {"Data": {"Name": "Image", "Value": "x"}}}}
    rows = [("1", json.dumps(flat)), ("2", json.dumps(json.dumps(nested))), ("3", json.dumps(listed)), ("4", json.dumps(single)), ("5", "{broken"), ("6", None), ("7", '{"a":1}')]
    out = {r["uid"]: r for r in parse_records(spark.createDataFrame(rows, "uid string, raw string"), "uid", "raw", F.lit("-04:00")).collect()}
    a, d = out["1"], out["1"]["document"]
    assert (a["reject"], a["source"], a["event_code"], a["class_uid"], a["activity_id"], a["process_name"], a["process_id"], a["dst_ip"], a["user_name"], a["host"]) == (None, "sysmon", "3", 4001, 1, "C:\\a\\b.exe", 31, "10.0.0.1", "D\\ann", "h")
    assert a["time_us"] == 1707134400500000
    assert set(a["unmapped"]) == {"DestinationPort", "RuleName", "EventTime"}
    assert (d["type_uid"], d["severity_id"], d["time"], d["dst_endpoint"]["port"], d["src_endpoint"], d["actor"]["user"]["domain"], d["actor"]["process"]["name"], d["process"]) == (400101, 3, 1707134400500, None, None, "D", "b.exe", None)
    assert (d["provenance"]["time_field"], d["provenance"]["time_utc_offset"], d["metadata"]["log_name"]) == ("UtcTime", "+00:00", "Microsoft-Windows-Sysmon/Operational")
    assert (out["2"]["source"], out["2"]["class_uid"], out["2"]["user_name"], out["2"]["host"]) == ("winsec", 3001, "D\\bob", "g")
    assert (out["3"]["class_uid"], out["3"]["activity_id"], out["3"]["document"]["reg_key"]["path"]) == (201001, 99, "r2")
    assert set(out["3"]["unmapped"]) == {"ObjectType"}
    assert (out["4"]["class_uid"], out["4"]["unmapped"], out["4"]["reject"]) == (0, {"Image": "x"}, "no time")
    assert [out[k]["reject"] for k in "567"] == ["unreadable", "unreadable", "no channel"]
    counts = reject_counts(parse_records(spark.createDataFrame(rows, "uid string, raw string"), "uid", "raw", F.lit("-04:00")))
    assert {r["reject"]: r["n"] for r in counts.collect()} == {"": 3, "no time": 1, "unreadable": 2, "no channel": 1}


def test_documents_of_security_records(spark):
    base = {"Channel": "Security", "EventTime": "2020-05-01 08:00:00", "SourceName": "Audit", "RecordNumber": 5, "@timestamp": "2020-05-01T12:00:01.250Z", "EventType": "AUDIT_FAILURE", "SubjectUserName": "sue", "SubjectDomainName": "D", "SubjectUserSid": "S-1"}
    records = {
        "start": {"EventID": 4688, "NewProcessId": "0x10", "NewProcessName": "c:\\n.exe", "CommandLine": "n -x", "ProcessId": "0x4", "ParentProcessName": "c:\\p.exe", "TargetUserName": "bob", "TargetDomainName": "-"},
        "logon": {"EventID": 4624, "TargetUserName": "bob@x", "TargetDomainName": "D", "IpAddress": "::ffff:10.0.0.4", "IpPort": "0", "LogonType": "3", "AuthenticationPackageName": "NTLM", "ProcessName": "-", "WorkstationName": "W"},
        "group": {"EventID": "4732", "TargetUserName": "Admins", "TargetSid": "S-2", "MemberName": "m", "MemberSid": "S-3"},
        "value": {"EventID": 4657, "ObjectName": "k", "ObjectValueName": "v", "NewValue": "1", "ProcessId": "x"},
        "no value": {"EventID": 4657, "ObjectName": "-", "ObjectValueName": "v"},
        "filter": {"EventID": 5156, "Application": "c:\\a.exe", "Protocol": "6", "SourceAddress": "127.0.0.1", "SourcePort": "80", "DestAddress": "bad", "DestPort": "70000"},
        "other kind": {"EventID": 4656, "ObjectType": "Token", "ObjectName": "o", "ProcessName": "c:\\h.exe"},
        "callers": {"EventID": 4798, "CallerProcessId": "7", "CallerProcessName": "c:\\c.exe"},
        "envelope": {"EventID": 1, "Channel": "System", "AccountName": "acc", "Domain": "NT", "UserID": "S-9"},
    }
    rows = spark.createDataFrame([(k, json.dumps({**base, **v})) for k, v in records.items()], "uid string, raw string")
    out = {r["uid"]: r for r in parse_records(rows, "uid", "raw", F.lit("-04:00")).collect()}
    d = {k: r["document"] for k, r in out.items()}
    a = out["start"]
    assert (a["process_name"], a["process_id"], a["command_line"], a["parent_process"], a["user_name"], a["time_us"]) == ("c:\\n.exe", 16, "n -x", "c:\\p.exe", "D\\sue", 1588334400000000)
    assert (d["start"]["process"]["user"]["name"], d["start"]["process"]["parent_process"]["pid"], d["start"]["actor"]["process"]["pid"], set(a["unmapped"])) == ("bob", 4, 4, {"TargetDomainName"})
    assert (d["start"]["status"], d["start"]["metadata"]["logged_time"], d["start"]["metadata"]["sequence"], d["start"]["metadata"]["product"]["name"]) == ("Failure", 1588334401250, 5, "Audit")
    b = out["logon"]
    assert (b["user_name"], b["src_ip"], b["process_name"], d["logon"]["src_endpoint"]["port"], d["logon"]["logon_type_id"], d["logon"]["auth_protocol"], d["logon"]["src_endpoint"]["hostname"], set(b["unmapped"])) == ("bob@x", "10.0.0.4", None, 0, 3, "NTLM", "W", {"ProcessName"})
    assert (d["group"]["group"]["name"], d["group"]["group"]["uid"], d["group"]["user"]["name"], d["group"]["user"]["uid"], out["group"]["user_name"]) == ("Admins", "S-2", "m", "S-3", "D\\sue")
    assert (tuple(d["value"]["reg_value"]), set(out["value"]["unmapped"])) == (("k", "v", "1"), {"ProcessId"})
    assert (d["no value"]["reg_value"], set(out["no value"]["unmapped"])) == (None, {"ObjectName", "ObjectValueName"})
    c = d["filter"]
    assert (c["actor"]["process"]["file"]["path"], c["connection_info"]["protocol_num"], c["src_endpoint"]["ip"], c["src_endpoint"]["port"], c["dst_endpoint"]) == ("c:\\a.exe", 6, "127.0.0.1", 80, None)
    assert {"DestAddress", "DestPort", "SubjectUserName"} <= set(out["filter"]["unmapped"])
    assert (out["other kind"]["class_uid"], out["other kind"]["process_name"], set(out["other kind"]["unmapped"])) == (0, "c:\\h.exe", {"ObjectType", "ObjectName"})
    assert (out["callers"]["process_name"], out["callers"]["process_id"]) == ("c:\\c.exe", 7)
    assert (out["envelope"]["source"], out["envelope"]["user_name"], d["envelope"]["actor"]["user"]["uid"]) == ("winevt", "NT\\acc", "S-9")


def test_values_of_every_layout(spark, tmp_path):
    data = {"ProcessId": "0x1f", "port": "80", "Hashes": "MD5=A"}
    docs = [{"Channel": "c", **data}, {"winlog": {"channel": "c", "event_data": data}}, {"Event": {"System": {"EventID": 1}, "EventData": {"Data": [{"Name": k, "Value": v} for k, v in data.items()]}}}]
    texts = [json.dumps(d) for d in docs]
    rows = list(enumerate([*texts, json.dumps(texts[0]), "{broken"]))
    spark.createDataFrame(rows, "id bigint, raw string").write.parquet(str(tmp_path / "telemetry.parquet"))
    assert sorted(map(tuple, reference.numeric_parse(spark, str(tmp_path)).collect())) == [(0, 31, 80), (1, 31, 80), (2, 31, 80), (3, 31, 80)]
    assert sorted(map(tuple, reference.hashes_parse(spark, str(tmp_path)).collect())) == [(i, "MD5", "A") for i in range(4)]


def test_every_reject_reason_is_counted(spark, tmp_path):
    base = {"Channel": "Security", "EventID": 4720, "EventTime": "2020-05-01 08:00:00"}
    docs = [json.dumps(base), "{broken", json.dumps({**base, "Channel": None}), json.dumps({**base, "EventID": None}), json.dumps({**base, "EventTime": None})]
    rows = [(f"a/{i}", d, at(0)) for i, d in enumerate(docs)] + [("b/9", docs[0], at(0))]
    spark.createDataFrame(rows, "uid string, raw string, ingested_at timestamp").write.parquet(str(tmp_path / "telemetry.parquet"))
    spark.createDataFrame([("a", "-04:00"), ("b", None)], "dataset string, event_time_offset string").write.parquet(str(tmp_path / "datasets.parquet"))
    got = {r["reject"]: r["n"] for r in reference.reject_counting(spark, str(tmp_path)).collect()}
    assert got == {"": 1, "unreadable": 1, "no channel": 1, "no event number": 1, "no time": 2}  # b has no zone


def test_event_line(spark):
    raw = json.dumps({"DestinationPort": "8080", "Channel": "x"})
    schema = "id bigint, ts timestamp, host string, user_name string, event_code string, process_name string, parent_process string, command_line string, file_path string, src_ip string, dst_ip string, ocsf string, raw string"
    doc = json.dumps({"dst_endpoint": {"port": 443}, "process": {"name": "t.exe"}, "unmapped": {"ShareName": "s", "GrantedAccess": ""}})
    rows = [(999999, at(450), "S", None, "3", None, None, None, None, None, "198.51.100.66", None, raw.replace("8080", "443")), (1, at(450), "S", None, "3", None, None, None, None, None, "198.51.100.66", doc, raw), (2, at(0), *[None] * 9, "broken", None)]
    columns = ["id", "ts", "host", "user_name", "event_code", "process_name", "parent_process", "command_line", "file_path", "src_ip", "dst_ip", "m"]
    got = rules.with_document(with_record(spark.createDataFrame(rows, schema), "raw", "m"), columns).select("id", event_line(F.col("m"), F.col("o")).alias("line"))
    assert {r["id"]: r["line"] for r in got.collect()} == {
        999999: "Event 999999 | TS=2020-05-02T03:07:30.000000+00:00 | Host=S | Code=3 | Net=->198.51.100.66:443",
        1: "Event 1 | TS=2020-05-02T03:07:30.000000+00:00 | Host=S | Code=3 | TargetProc=t.exe | Net=->198.51.100.66:443 (RawLog DestinationPort=8080 CONFLICT) | Share=s",
        2: "Event 2 | TS=2020-05-02T03:00:00.000000+00:00 | Code=",
    }


# --- verdicts, lookups, incidents --------------------------------------------------------------------


def test_verdicts_and_techniques(spark):
    sentences = spark.createDataFrame([(1, 10, "T1"), (2, 10, "T2"), (3, 10, None), (4, 11, "T3"), (5, 10, "T1"), (6, None, "T4"), (7, 10, "T5")], "id bigint, incident_id bigint, technique_id string")
    verdicts = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (5, False)], "sentence_id bigint, supported boolean")
    incidents = spark.createDataFrame([(10, "open"), (11, "suppressed"), (12, None)], "id bigint, status string")
    assert [r["id"] for r in accuracy.supported_techniques(sentences, verdicts, incidents).collect()] == ["T1"]
    assert [r["id"] for r in accuracy.unsupported_only(sentences, verdicts, incidents).collect()] == ["T2"]
    assert sorted(map(tuple, accuracy.unverified(sentences, verdicts).collect())) == [(10, 1), (11, 0)]
    events = spark.createDataFrame([(90, "a.exe", " run ", None), (91, None, "", '{"CommandLine":"","Message":"m"}'), (92, "b", None, "{broken")], "id bigint, process_name string, command_line string, raw string")
    cited = spark.createDataFrame([(1, 90), (1, 91), (1, 92), (2, 90)], "sentence_id bigint, event_id bigint")
    got = accuracy.justifications(sentences, verdicts, incidents, spark.createDataFrame([("T1",)], "id string"), cited, events).collect()
    assert sorted((r["technique_id"], r["sentence_id"], r["event_id"], r["command"]) for r in got) == [("T1", 1, 90, "run"), ("T1", 1, 91, "m"), ("T1", 1, 92, "")]


def test_incidents_are_matched_by_start_and_hosts(spark):
    old = spark.createDataFrame([(3, at(0), ["b", "a"]), (5, at(0), ["a", "b"]), (9, at(1), None)], "id bigint, first_seen timestamp, hosts array<string>")
    found = spark.createDataFrame([(at(0), ["a", "b"], 7), (at(1), [], 1), (at(2), ["c"], 2), (at(0), ["a"], 4)], "first_seen timestamp, hosts array<string>, n int")
    got = {(r["n"], r["id"], r["change"]) for r in upsert.upsert_incidents(old, found).collect()}
    assert got == {(7, 5, "update"), (1, 9, "update"), (4, 10, "insert"), (2, 11, "insert")}
    assert {r["id"] for r in upsert.upsert_incidents(old.limit(0), found).collect()} == {1, 2, 3, 4}
    assert upsert.upsert_incidents(old, found.limit(0)).count() == 0


def test_clear_keeps_other_tables(spark, tmp_path):
    for name in ("alerts", "incidents"):
        spark.range(3).write.parquet(str(tmp_path / name))
    upsert.clear_tables(spark, {str(tmp_path / "alerts"): spark.range(1).schema})
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 0 and spark.read.parquet(str(tmp_path / "incidents")).count() == 3


def test_numbers_follow_the_order(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, 3]), i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, _p string").repartition(7)
    got = {x["b"]: x["no"] for x in numbered(df.drop("_p"), [F.col("a").desc_nulls_last(), F.col("b")], "no").collect()}
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert got == {x[1]: k for k, x in enumerate(want, 1)}
    assert numbered(df.drop("_p").limit(0), ["b"], "no").count() == 0


def test_lookups_and_members(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id bigint, tags array<string>")
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "tag string")
    assert sorted((r["id"], r["tag"]) for r in search.members(rows, "tags", wanted, "tag").collect()) == [(1, "a"), (1, "b")]
    ids = spark.createDataFrame([(1,), (1,), (None,), (8,)], "id bigint")
    assert [r["id"] for r in search.by_ids(rows, ids, "id").collect()] == [1]


def test_dry_run_stands_in_for_a_model(spark):
    prompts = spark.createDataFrame([("about PowerShell",), ("other",), (None,)], "p string")
    got = validate.with_model(prompts, validate.dry_run({"powershell": "T1059.001"}, "NONE"), "p").collect()
    assert [r["answer"] for r in got] == ["T1059.001", "NONE", "NONE"]


def test_addresses_and_numbers_of_records(spark):
    def one(f, *values):
        return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]

    assert one(parse.ip_value, "127.0.0.1", "::1", "fe80::1%eth0", "::ffff:10.0.0.1", "FF02::1", "1.2.3", "x", "-", None) == ["127.0.0.1", "::1", "fe80::1%eth0", "::ffff:10.0.0.1", "FF02::1", None, None, None, None]
    assert one(parse.number_value, "0x7FFFFFFFFFFFFFFF", "0x8000000000000000", "0x000000000000000000001f", "0x0", "0x", "12", "-3", "99999999999999999999") == [2**63 - 1, None, 31, 0, None, 12, -3, None]
    assert one(parse.port_value, "0000000000080", "65535", "65536", "", "8a") == [80, 65535, None, None, None]


def test_chain_of_hashes(spark):
    rows = spark.createDataFrame([(i, at(i), "a", "b", None if i == 2 else "{}") for i in range(1, 50)], "id bigint, ts timestamp, actor string, action string, detail string")
    shown = F.concat(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    log = audit.chained(rows.withColumn("shown", shown).repartition(5))
    assert audit.verify(log).first()[:] == (True, 49, None)
    assert audit.verify(log.withColumn("actor", F.when(F.col("id") == 7, "z").otherwise(F.col("actor")))).first()[:] == (False, 49, 7)


# --- streaming -----------------------------------------------------------------------------------


def test_streams(spark):
    from siltstone.operators.sessions import SessionTable

    source, schema = scratch_path(spark, "in"), "uid string, h string, ts timestamp, at bigint, id int"
    rows = [(f"r{i % 40}", "A" if i % 3 else "B", at(i * 100), (i % 40) * 100, i) for i in range(60)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = SessionTable(spark, scratch_path(spark, "s"), ["h"], "at", 250, "uid", ("id",))
    windows.into_sessions(stream, table, scratch_path(spark, "c1")).awaitTermination(120)
    assert table.read().agg(F.sum("n_events")).first()[0] == 40
    target = scratch_path(spark, "t")
    windows.into_table(stream, target, "uid", ["id"], scratch_path(spark, "c2")).awaitTermination(120)
    assert spark.read.parquet(target).count() == 40
    for name, df in (("b", windows.beacon_counts(stream, ["h"], "ts")), ("s", windows.sessions(stream, ["h"], "ts")), ("d", windows.first_deliveries(stream, "uid", "ts", "1 day"))):
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode("append").option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("q_d").count() == 40
    assert spark.table("q_b").agg(F.sum("n")).first()[0] <= 60
