"""The general problems: edge cases and comparison with brute force."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.operators.eager import eager_join_aggregate, key_states, longest_gap_by_key
from siltstone.operators.features import entity_features, features_long
from siltstone.operators.sessions import SessionTable, local_sessions, split_batches
from siltstone.operators.shred import _parse_deep, adjacency, document_nodes, entity_table, node_paths, object_nodes, parse_document, scalar_values, stored_adjacency
from siltstone.operators.timestamps import clock_zone, normalise
from siltstone.session import scratch_path

# --- shredding ---------------------------------------------------------------------------------


def objects(spark, documents):
    rows = spark.createDataFrame(list(enumerate(documents)), "id bigint, ocsf string").withColumn("node", F.lit("clash"))
    return sorted((r["id"], r["node_path"], r["parent_path"]) for r in object_nodes(node_paths(adjacency(rows, "id", ["ocsf"]), "id")).collect())


def test_objects_of_all_shapes(spark):
    documents = [
        '{"a":{"b":[{"c":{}},1,[{}]]},"d":{}}',
        json.dumps(json.dumps({"x": {"y": 1}})),
        None, "", "{bad", '"text"', "3", "[]", "{}", "null", '{"a":NaN}',
        '[{"k":{}}]',
        '{"a/b":{"":{}}}',
        '{"s":{"t":"\\ud800"}}',
    ]
    assert objects(spark, documents) == sorted([
        (0, "/a", "/"), (0, "/a/b/0", "/a"), (0, "/a/b/0/c", "/a/b/0"), (0, "/a/b/2/0", "/a"), (0, "/d", "/"),
        (1, "/x", "/"), (11, "/0", "/"), (11, "/0/k", "/0"), (12, "/a/b", "/"), (12, "/a/b/", "/a/b"), (13, "/s", "/"),
    ])


def test_no_documents(spark):
    nodes = adjacency(spark.createDataFrame([], "id bigint, d string"), "id", ["d"])
    assert nodes.count() == node_paths(nodes, "id").count() == entity_table(nodes, "id", "a", ["b"]).count() == 0


def test_adjacency_rows_and_wide_documents(spark):
    assert document_nodes({"a": [1, {"b": None}], "c": True}) == [
        (1, 0, "a", None, "array", None), (2, 0, "c", None, "boolean", "true"), (3, 1, "a", 0, "number", "1"), (4, 1, "a", 1, "object", None), (5, 4, "b", None, "null", None),
    ]
    wide = json.dumps({"x": [{"n": i} for i in range(60_000)], "y": {"z": list(range(60_000))}})  # more nodes than a batch holds
    nodes = adjacency(spark.createDataFrame([(1, wide), (2, '{"k":{}}')], "id bigint, d string"), "id", ["d"])
    paths = {(r["id"], r["node_path"]) for r in object_nodes(node_paths(nodes, "id")).collect()}
    assert paths == {(1, f"/x/{i}") for i in range(60_000)} | {(1, "/y"), (2, "/k")}
    assert scalar_values(nodes, "id").where("parent_path = '/y'").count() == 60_000


def test_rows_of_one_key_are_not_mixed(spark):
    texts = ['{"a":{"b":{"n":1}}}', '{"c":[{"d":{}}],"e":{"n":2}}', '{"a":{"b":{"n":3}}}', None]
    rows = spark.createDataFrame([(k, t, "clash", 0) for k in (1, 1, None) for t in texts], "id bigint, d string, doc string, row int").repartition(3)
    nodes = adjacency(rows.select("id", "d", "doc", "row"), "id", ["d"])
    got = sorted((str(r["id"]), r["node_path"], r["parent_path"]) for r in object_nodes(node_paths(nodes, "id")).collect())
    one = [("/a", "/"), ("/a/b", "/a"), ("/c/0", "/"), ("/c/0/d", "/c/0"), ("/e", "/"), ("/a", "/"), ("/a/b", "/a")]
    assert got == sorted((k, *p) for k in ("1", "1", "None") for p in one)
    stored = stored_adjacency(rows, "id", ["d"])
    assert sorted(r["a_n"] for r in entity_table(stored, "id", "b", ["n"]).collect()) == ["1", "1", "1", "3", "3", "3"]
    assert [r["a_n"] for r in entity_table(stored, "id", "e", ["n"]).collect()] == ["2"] * 3


def test_many_wrappings():
    text = "[{}]"
    for _ in range(8):
        text = json.dumps(text)
    assert parse_document(text) == [{}]


def test_very_deep_and_very_long():
    deep = '{"a":' * 30_000 + "{}" + "}" * 30_000
    value, depth = parse_document(deep), 0
    while value:
        value, depth = value["a"], depth + 1
    assert depth == 30_000
    for text in ('{"a":[1,-2.5e3,true,false,null,"x\\n",{},[]],"b":{"c":"d"}}', "[]", ' { "a" : [ ] } '):
        assert _parse_deep(text) == json.loads(text)


def test_entity_table(spark):
    text = '{"process":{"pid":7,"name":null,"file":{"path":"p"},"process":[{"pid":8},{"pid":"9","name":"n","pid2":1}]},"tags":["a",null,"b"]}'
    nodes = adjacency(spark.createDataFrame([(1, text)], "id bigint, d string"), "id", ["d"])
    got = {r["node_path"]: (r["parent_path"], r["ordinal"], r["a_pid"], r["a_name"]) for r in entity_table(nodes, "id", "process", ["pid", "name"]).collect()}
    assert got == {"/process": ("/", None, "7", None), "/process/process/0": ("/process", 0, "8", None), "/process/process/1": ("/process", 1, "9", "n")}
    scalars = [(r["label"], r["ordinal"], r["scalar"], r["kind"]) for r in nodes.where("label = 'tags' and kind <> 'array'").orderBy("ordinal").collect()]
    assert scalars == [("tags", 0, "a", "string"), ("tags", 1, None, "null"), ("tags", 2, "b", "string")]


# --- eager aggregation, features, sessions --------------------------------------------------------


def random_events(seed, n=400):
    r = random.Random(seed)
    return [(r.choice(["A", "A", "A", "B", None]), r.choice(["1", "1", "2", None]), r.choice([None, *range(0, 40_000_000_000, 377_000_000)]), i) for i in range(n)]


def by_key(rows):
    out = defaultdict(list)
    for a, b, t, _ in rows:
        if a is not None and b is not None and t is not None:
            out[a, b].append(t)
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(params=[(1, 10_000), (4, 3), (40, 1)])
def pieces(spark, request):
    """Partitions and Arrow batches of several sizes, so that keys are cut in many places."""
    parts, records = request.param
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": records, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, str(v))
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def test_longest_gap(spark, pieces):
    rows = random_events(1)
    df = spark.createDataFrame(rows, "h string, c string, at bigint, n int")
    want = {k: (len(v), max([b - a for a, b in zip(v, v[1:])], default=0)) for k, v in by_key(rows).items()}
    for tie in (None, "n"):
        got = {(r["h"], r["c"]): (r["n_events"], r["max_gap_us"]) for r in longest_gap_by_key(df, ["h", "c"], "at", tie).collect()}
        assert got == want
    assert longest_gap_by_key(df.limit(0), ["h", "c"], "at").count() == 0


def test_a_hot_key_becomes_few_states(spark, pieces):
    rows = [("hot", "1", 7 if i % 3 else i, i) for i in range(600)] + [(f"h{i}", "1", i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "h string, c string, at bigint, i bigint")
    states = key_states(df, ["h", "c"], "at", "i")
    assert states.count() <= 31 + pieces[0] and states.agg(F.sum("n")).first()[0] == 630
    got = {r["h"]: (r["n_events"], r["max_gap_us"]) for r in longest_gap_by_key(df, ["h", "c"], "at", "i").collect()}
    assert got["hot"] == (600, 3) and got["h3"] == (1, 0) and len(got) == 31


def test_eager_join_equals_plain_join(spark):
    a = spark.createDataFrame([("x", "p", 1), ("x", "p", None), ("x", "q", 5), ("y", "p", 2), (None, "p", 9)], "k string, g string, v bigint")
    b = spark.createDataFrame([("x", "s", 10), ("x", "t", 20), ("x", "t", None), (None, "s", 1), ("z", "s", 3)], "k string, w string, u bigint")
    plain = a.join(b, "k").groupBy("g", "w").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("v").alias("sv"), F.sum("u").alias("su"))
    eager = eager_join_aggregate(a, b, ["k"], ["g", "w"], {"sv": F.col("v")}, {"su": F.col("u")})
    assert sorted(map(tuple, eager.collect())) == sorted(map(tuple, plain.collect()))


def test_features(spark):
    rows = random_events(2)
    df = spark.createDataFrame(rows, "h string, c string, at bigint, total int")
    latest = max(t for *_, t, _ in rows if t is not None)
    want = {}
    for (h, c), v in by_key(rows).items():
        total = sum(len(x) for k, x in by_key(rows).items() if k[0] == h)
        want[h, c] = (len(v), sum(t >= latest - 10**9 for t in v), latest - v[-1], total)
    everyone = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "h string")
    wide = entity_features(df, "h", "c", "at", F.lit(latest), 3, 10**9, everyone)
    assert {r["h"]: r["total"] for r in wide.collect()} == {"A": sum(want[k][0] for k in want if k[0] == "A"), "B": sum(want[k][0] for k in want if k[0] == "B"), "C": 0}
    got = {(r["h"], r["c"]): (r["n"], r["n_recent"], r["idle_us"], r["total"]) for r in features_long(wide, "h", "c").collect()}
    assert got == want
    empty = entity_features(df.limit(0), "h", "c", "at", None, 3, 10**9, everyone)
    assert {(r["h"], r["total"], r["last_us"]) for r in empty.collect()} == {("A", 0, None), ("B", 0, None), ("C", 0, None)}


def test_feature_blocks_join_without_a_shuffle(spark):
    df = spark.createDataFrame(random_events(2), "h string, c string, at bigint, total int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = entity_features(df, "h", "c", "at", 10**12, 3, 10**9, df, buckets=4)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_sessions(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_sessions_in_any_batches(spark):
    rows = random_events(3)
    gap = 377_000_000
    df = spark.createDataFrame(rows, "h string, u string, at bigint, id int").withColumns({"uid": F.concat(F.lit("r"), F.col("id") % 300), "seen": F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(1000)))})
    first = {}
    for h, u, t, i in rows:
        if None not in (h, u, t):
            first[f"r{i % 300}"] = min(first.get(f"r{i % 300}", (10**9, 0, 0, 0, 0)), ((i * 7919) % 1000, i, h, u, t))
    grouped = defaultdict(list)
    for *_, h, u, t in first.values():
        grouped[h, u].append(t)
    want = sorted((h, u, *s) for (h, u), v in grouped.items() for s in brute_sessions(v, gap))
    whole = df.where("h is not null and u is not null and at is not null")
    for n in (1, 4):
        table = SessionTable(spark, scratch_path(spark, "t"), ["h", "u"], "at", gap, "uid", ("seen", "id"))
        batches = split_batches(whole, "seen", n)
        assert sum(b.count() for b in batches) == whole.count()
        for b in batches:
            table.apply(b)
            table.apply(b)  # a replay changes nothing
        assert sorted(map(tuple, table.read().collect())) == want
    table.apply(whole.limit(0))
    assert table.read().count() == len(want)


def test_session_table_keeps_old_states_and_untouched_cells(spark):
    table = SessionTable(spark, scratch_path(spark, "t"), ["k"], "t", 10, "uid", ("t",))
    day = 86_400_000_000

    def batch(*rows):
        return spark.createDataFrame(list(rows), "uid string, k string, t bigint")

    table.apply(batch(*((f"{k}{d}", k, d * day) for k in "abcdefgh" for d in range(3))))
    old, before = table.read(), table._manifest()
    table.apply(batch(("late", "a", day + 5), ("a1", "a", day)))  # a late event, and a record seen before
    after = table._manifest()
    changed = [c for c in after["cells"] if after["cells"][c] != before["cells"].get(c)]
    assert len(changed) == 1 and changed[0].startswith("1/")
    assert sorted(r["n_events"] for r in table.read().collect()) == [1] * 23 + [2]
    assert old.count() == 24 and old.agg(F.sum("n_events")).first()[0] == 24  # the old state can still be read
    table.vacuum(1)
    assert len(table._versions()) == 1 and sorted(r["n_events"] for r in table.read().collect()) == [1] * 23 + [2]


def test_two_writers_cannot_publish_one_version(spark):
    table = SessionTable(spark, scratch_path(spark, "t"), ["k"], "t", 10)
    table._fs.create(table._at("claims/000000001.json"), False).close()  # a writer that died before it published
    with pytest.raises(RuntimeError, match="recover"):
        table.apply(spark.createDataFrame([("a", 1)], "k string, t bigint"))
    assert table.read().count() == 0
    table.recover()
    table.apply(spark.createDataFrame([("a", 1)], "k string, t bigint"))
    assert table.read().count() == 1


def test_seen_records_of_a_day_are_written_into_one_folder(spark):
    table = SessionTable(spark, scratch_path(spark, "t"), ["k"], "t", 10, "uid", ("t",))
    table.SEEN_FOLDERS = 2
    for i in range(5):
        rows = spark.createDataFrame([(f"u{j}", "a", 100 * j) for j in range(i + 1)], "uid string, k string, t bigint")
        table.apply(rows)
    assert max(map(len, table._manifest()["seen"].values())) <= 2
    assert sorted(r["n_events"] for r in table.read().collect()) == [1] * 5


def test_session_gap_is_inclusive_and_ties_count(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 10), ("a", 21), (None, 5), ("a", None)], "k string, t bigint")
    assert sorted(map(tuple, local_sessions(df, ["k"], "t", 10).collect())) == [("a", 0, 10, 3), ("a", 21, 21, 1)]
    assert local_sessions(df.limit(0), ["k"], "t", 10).count() == 0


# --- timestamps ------------------------------------------------------------------------------------


def us(text):
    return int((datetime.fromisoformat(text).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


NY, BERLIN = "America/New_York", "Europe/Berlin"
STAMPS = [
    # text, zone, date order, received, instant
    ("2024-05-01T10:00:00.1234567Z", None, None, "2024-05-02", us("2024-05-01T10:00:00.123456")),
    ("2024-05-01t10:00:00z", None, None, "2024-05-02", us("2024-05-01T10:00:00")),
    (" 2024-05-01 10:00:00,5\t", "-04:00", None, "2024-05-02", us("2024-05-01T14:00:00.5")),
    ("2024-05-01 10:00:00", None, None, "2024-05-02", None),
    ("2024-05-01T10:00:00.5\u221204:00", BERLIN, None, "2024-05-02", us("2024-05-01T14:00:00.5")),
    ("2024-05-01 10:00:00 CEST", None, None, "2024-05-02", us("2024-05-01T08:00:00")),
    ("2024-05-01 10:00:00 XYZ", "+00:00", None, "2024-05-02", None),
    ("20240501T100000+0530", None, None, "2024-05-02", us("2024-05-01T04:30:00")),
    ("20240501100000.123456-240", None, None, "2024-05-02", us("2024-05-01T14:00:00.123456")),
    ("01.05.2024 10:00:00", "+00:00", None, "2024-05-02", us("2024-05-01T10:00:00")),
    ("05/01/2024 12:30:00 AM", "+00:00", "mdy", "2024-05-02", us("2024-05-01T00:30:00")),
    ("05/01/2024 12:30:00 PM", "+00:00", "dmy", "2024-05-02", us("2024-01-05T12:30:00")),
    ("05/01/2024 13:30:00 PM", "+00:00", "dmy", "2024-05-02", None),
    ("05/01/2024 12:30:00", "+00:00", None, "2024-05-02", None),
    ("01/May/2024:10:00:00 -0400", None, None, "2024-05-02", us("2024-05-01T14:00:00")),
    ("Wed, 1 May 2024 10:00:00 +0200", None, None, "2024-05-02", us("2024-05-01T08:00:00")),
    ("Tue, 1 May 2024 10:00:00 +0200", None, None, "2024-05-02", None),
    ("May  1 10:00:00", "+00:00", None, "2024-05-02", us("2024-05-01T10:00:00")),
    ("Dec 31 23:59:59", "+00:00", None, "2024-01-01", us("2023-12-31T23:59:59")),
    ("Feb 29 10:00:00", "+00:00", None, "2027-05-02", us("2024-02-29T10:00:00")),
    ("Jan  1 08:00:00", "+11:00", None, "2023-12-31T23:00:00", us("2023-12-31T21:00:00")),
    ("1714557600", None, None, "2024-05-02", us("2024-05-01T10:00:00")),
    ("1714557600.25", None, None, "2024-05-02", us("2024-05-01T10:00:00.25")),
    ("1714557600123", None, None, "2024-05-02", us("2024-05-01T10:00:00.123")),
    ("1714557600123456", None, None, "2024-05-02", us("2024-05-01T10:00:00.123456")),
    ("133590312001234567", None, None, "2024-05-02", us("2024-05-01T10:00:00.123456")),
    ("133910246502008297", None, None, "2025-06-01", 1746551050200829),
    ("2024-02-30 10:00:00", "+00:00", None, "2024-05-02", None),
    ("2024-05-01 25:00:00", "+00:00", None, "2024-05-02", None),
    ("2024-05-01 10:00:60", "+00:00", None, "2024-05-02", None),
    ("0000-00-00 00:00:00", "+00:00", None, "2024-05-02", None),
    ("2024-05-01 00:7", "+00:00", None, "2024-05-02", None),
    ("2024-05-03 00:00:00", "+00:00", None, "2024-05-02", None),  # after it was received
    ("2024-03-10 02:30:00", NY, None, "2024-03-11", None),  # skipped
    ("2024-11-03 01:30:00", NY, None, "2024-11-03T05:40:00", us("2024-11-03T05:30:00")),  # twice: the first
    ("2024-11-03 01:30:00", NY, None, "2024-11-03T06:40:00", us("2024-11-03T06:30:00")),  # twice: the second
    ("2024-11-03 01:30:00", NY, None, "2024-11-05", None),  # twice, and neither within the hour
    ("2024-11-03 02:30:00", NY, None, "2024-11-05", us("2024-11-03T07:30:00")),
    ("N/A", "+00:00", None, "2024-05-02", None), ("", "+00:00", None, "2024-05-02", None), (None, "+00:00", None, "2024-05-02", None),
    ("x" * 100_000, "+00:00", None, "2024-05-02", None),
]


def test_stamps(spark):
    rows = [(i, *s[:3], datetime.fromisoformat(s[3]).replace(tzinfo=timezone.utc)) for i, s in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "i int, ts string, zone string, o string, rec timestamp").withColumns({"_f": F.lit(1), "_wall": F.lit("x")})
    got = {r["i"]: r["ts_us"] for r in normalise(df, "ts", F.col("zone"), F.col("o"), F.col("rec")).collect()}
    assert {i: (s[0], got[i]) for i, s in enumerate(STAMPS)} == {i: (s[0], s[4]) for i, s in enumerate(STAMPS)}
    assert normalise(df.limit(0), "ts", F.col("zone"), F.col("o"), F.col("rec")).count() == 0


def test_stamp_without_receipt(spark):
    df = spark.createDataFrame([("2024-05-01 10:00:00",), ("May  1 10:00:00",), ("2024-11-03 01:30:00",)], "ts string")
    got = normalise(df, "ts", F.lit(NY), F.lit(None).cast("string"), F.lit(None).cast("timestamp")).collect()
    assert [r["ts_us"] for r in got] == [us("2024-05-01T14:00:00"), None, None]


def test_clocks(spark):
    cases = {
        "-04:00": "-04:00", "+0530": "+05:30", "-PT4H": "-04:00", "PT5H30M": "+05:30", "-1 day, 20:00:00": "-04:00", "5:30:00": "+05:30", "19800": "+05:30", "-14400": "-04:00",
        "UTC": "+00:00", "UTC+01:00": "+01:00", "GMT-3": "-03:00", "Z": "+00:00", "0": "+00:00", NY: NY, "": None, "soon": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r["c"]: r["z"] for r in rows.select("c", clock_zone(F.col("c")).alias("z")).collect()} == cases
