"""Operators for training data: edge cases, brute force, round trips."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import lookalikes, mixing, packing, runs
from siltstone.llm.tokens import token_count

# --- runs --------------------------------------------------------------------------------------


def brute_runs(rows, gap, least):
    out, by = [], {}
    for e, k, i, t in rows:
        if e is not None and i is not None and t is not None:
            by.setdefault(e, []).append((t, i, k))
    for e, seq in by.items():
        cur = []
        for t, i, k in [*sorted(seq, key=lambda x: x[:2]), (None, None, None)]:
            if cur and (k is None or k != cur[-1][2] or t - cur[-1][0] > gap):
                if cur[0][2] is not None and len(cur) >= least:
                    out.append((e, cur[0][2], cur[0][1], cur[-1][1], cur[0][0], cur[-1][0], len(cur)))
                cur = []
            if i is not None:
                cur.append((t, i, k))
    return sorted(out)


@pytest.mark.parametrize("seed,parts,records,chunk", [(1, 1, 10_000, 50_000), (2, 5, 7, 3), (3, 60, 1, 1), (4, 3, 100, 2)])
def test_runs_equal_brute_force(spark, monkeypatch, seed, parts, records, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    r = random.Random(seed)
    rows = [(r.choice(["p", "p", "q", None]), r.choice(["a", "a", "a", "b", "c", None]), i, r.choice([None, *range(0, 300, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, "proc string, kind string, id bigint, at bigint").withColumns({"edge": F.lit(0), "entity": F.lit("x")})
    conf = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": records, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, str(v))
        for least in (1, 2):
            assert sorted(map(tuple, runs.collapse_runs(df, "proc", "kind", "id", "at", 5, least).collect())) == brute_runs(rows, 5, least)
        assert runs.collapse_runs(df.limit(0), "proc", "kind", "id", "at", 5).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_more_kinds_than_code_points(spark):
    """Kinds are numbered within a chunk, so their number over all has no limit."""
    n = 600_000
    rows = spark.range(2 * n).select(F.lit("p").alias("e"), (F.col("id") / 2).cast("bigint").alias("k"), "id", F.col("id").alias("at"))
    got = runs.collapse_runs(rows, "e", "k", "id", "at", 1, 2)
    assert got.count() == n and got.where("n_events <> 2 or first_id <> 2 * kind or last_id <> first_id + 1").count() == 0


# --- tokens and packing --------------------------------------------------------------------------


def test_token_counts(spark):
    texts = [None, "", "hello world", "<|endoftext|>", "a" * 200_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()]
    assert got[:2] == [0, 0] and got[2] == 2 and got[3] > 1 and got[4] > 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(40, 60))
def test_bound_and_packing(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    placed = packing.best_fit_decreasing(sizes, capacity)
    n = len(set(placed.tolist()))
    assert packing.lower_bound(sizes, capacity) <= n
    assert all(sizes[placed == b].sum() <= capacity for b in set(placed.tolist()))


def test_bound_knows_large_items():
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert packing.lower_bound(np.array([34, 34, 34]), 100) == 2
    assert packing.lower_bound(np.array([], dtype=np.int64), 10) == 0


@pytest.mark.parametrize("partition_items", [100_000, 40])
def test_pack_is_whole(spark, partition_items):
    r = random.Random(7)
    sizes = [r.choice([r.randint(1, 60), r.randint(50, 900), 100, 0]) for _ in range(500)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(1000, None)], "doc_id bigint, n bigint").withColumn("part", F.lit("x"))
    specs = [(1, 100), (2, 333)]
    packed = packing.pack(items, "doc_id", "n", specs, partition_items)
    rows = packed.pieces.collect()
    for spec, capacity in specs:
        own = [x for x in rows if x["spec_id"] == spec]
        used, by_item = {}, {}
        for x in own:
            used[x["container"]] = used.get(x["container"], 0) + x["size"]
            by_item.setdefault(x["item_id"], []).append((x["piece"], x["start"], x["size"]))
        assert max(used.values()) <= capacity
        for i, s in enumerate(sizes):
            parts = sorted(by_item.pop(i, []))
            assert [p[0] for p in parts] == list(range(-(-s // capacity))) and sum(p[2] for p in parts) == s
            assert all(p[1] == k * capacity and (p[2] == capacity or k == len(parts) - 1) for k, p in enumerate(parts))
        assert not by_item
        assert len(used) <= 1.05 * -(-sum(sizes) // capacity) + 1
    report = {x["spec_id"]: x for x in packing.packing_report(packed, specs).collect()}
    for spec, capacity in specs:
        cut = [c for s in sizes for c in [capacity] * (s // capacity) + [s % capacity] if c]
        assert report[spec]["n_tokens"] == sum(sizes)
        assert report[spec]["least_containers"] == packing.lower_bound(np.array(cut), capacity) <= report[spec]["n_containers"]
        assert report[spec]["certified"] == (report[spec]["least_containers"] == report[spec]["n_containers"])


def test_nothing_to_pack(spark):
    packed = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n bigint"), "doc_id", "n", [(1, 10)])
    assert packed.pieces.count() == packed.rounds.count() == packing.packing_report(packed, [(1, 10)]).count() == 0


def test_items_of_one_id_are_packed_each(spark):
    items = spark.createDataFrame([(1, 25), (1, 25), (None, 10), (None, 10), (2, 3)], "doc_id bigint, n bigint").withColumn("number", F.lit("x"))
    rows = packing.pack(items, "doc_id", "n", [(1, 10)]).pieces.groupBy("container").agg(F.sum("size").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 73 and max(r["n"] for r in rows) == 10 and len(rows) == 8


def test_exchange_saves_containers(spark):
    """Partitions left alone need more containers than partitions that exchange; the exchange ends certified or without a gain."""
    r = random.Random(1)
    items = spark.createDataFrame([(i, r.randint(1, 50)) for i in range(600)], "doc_id bigint, n bigint")
    packed = packing.pack(items, "doc_id", "n", [(1, 100)], 40)
    rounds = sorted(map(tuple, packed.rounds.collect()), key=lambda x: x[1])
    report = packing.packing_report(packed, [(1, 100)]).first()
    first = rounds[0][6]
    gains = [x[5] - x[6] for x in rounds[1:]]
    assert len(rounds) > 1 and gains[0] > 0 and all(g > 0 for g in gains[:-1])
    assert report["n_containers"] == first - sum(g for g in gains if g > 0) < first
    assert report["n_exchanged"] > 0 and (report["certified"] or gains[-1] <= 0 or rounds[-1][2] == 1)


# --- mixing --------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700), st.integers(0, 2**63 - 1))
def test_permutation(size, key):
    index = np.arange(size)
    out = mixing.permuted(index, np.full(size, size), np.full(size, key, dtype=np.uint64))
    assert sorted(out.tolist()) == index.tolist()


def test_shards_meet_quotas():
    got = mixing.shard_counts({"a": 1000, "b": 37, "c": 1}, 3, 64)
    assert got.groupby("source")["n"].sum().to_dict() == {"a": 1000, "b": 37, "c": 1}
    assert got.groupby("shard")["n"].sum().max() <= 64
    for _, own in got.groupby("source"):
        assert own["first"].tolist() == [0, *own["n"].cumsum().tolist()[:-1]]


def test_shards_in_two_steps(spark):
    """Many shards come in groups, and still every slot of every source is in one shard."""
    slots = {"a": 50_000, "b": 7_001, "c": 3}
    rows = mixing.shard_table(spark, slots, 5, 10).toPandas().sort_values(["source", "first"])
    assert rows["shard"].nunique() == -(-sum(slots.values()) // 10) and rows.groupby("shard")["n"].sum().max() == 10
    for s, own in rows.groupby("source"):
        assert own["n"].sum() == slots[s] and own["first"].tolist() == [0, *own["n"].cumsum().tolist()[:-1]] and own["shard"].is_monotonic_increasing
    assert mixing.shard_table(spark, {}, 5).count() == 0


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    r = random.Random(5)
    docs = [(i, s, r.randint(1, 300)) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 5)]
    items = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint")
    blocks = mixing.lay_out(items, 16, {"a": 300, "b": 40, "c": 5})
    sizes = {r["doc_id"]: r["s"] for r in blocks.groupBy("doc_id").agg(F.sum("size").alias("s")).collect()}
    assert sizes == {i: n for i, _, n in docs}
    assert blocks.groupBy("source", "block").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] == 16
    tokens = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.15, 4), "absent": (0.05, 3)}
    mixture = mixing.mix(blocks, tokens, targets, 11, 16).cache()
    uses = {r["doc_id"]: r for r in mixing.document_uses(mixture).collect()}
    assert all(u["repeats"] <= targets[u["source"]][1] for u in uses.values())
    wanted = spark.createDataFrame([(s, w, m) for s, (w, m) in targets.items()], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r["actual_share"] for r in mixing.mixture_shares(mixture, wanted).collect()}
    assert shares["absent"] == 0 and all(abs(shares[s] - targets[s][0] / 0.95) < 0.02 for s in "abc")
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, mixing.mix(blocks, tokens, targets, 11, 16).collect()))
    assert mixing.mix(blocks.limit(0), {}, targets).count() == 0
    # The tokens of document d are d * 1000 + place: every block holds the stretches its pieces name, in order.
    held = items.withColumn("ids", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: (F.col("doc_id") * 1000 + k - 1).cast("int")))
    got = {(r["shard"], r["slot"], r["source"]): r["tokens"] for r in mixing.token_blocks(mixture, blocks, held, F.col("ids")).collect()}
    want = {}
    for p in sorted(mixture.collect(), key=lambda p: p["offset"]):
        want.setdefault((p["shard"], p["slot"], p["source"]), []).extend(range(p["doc_id"] * 1000 + p["start"], p["doc_id"] * 1000 + p["start"] + p["size"]))
    assert got == want


def test_source_spellings(spark):
    rows = spark.createDataFrame([("Script_Block",), ("script-block",), (" script block ",), (None,)], "s string")
    assert [r[0] for r in rows.select(mixing.source_key(F.col("s"))).collect()] == ["script_block"] * 3 + [None]


# --- look-alikes -----------------------------------------------------------------------------------

TEXTS = ["The office cafe\u0301 at BRANSEY39 raised CUR-214.", "Процесс открыл файл, наблюдение продолжается до конца смены: хост C:\\Temp", "Überprüfung der Maßnahme abgeschlossen", "x2 x\u00b2 x\u2460", "", "plain ascii\ttext"]


@pytest.fixture(scope="module")
def model(spark):
    return lookalikes.train(spark.createDataFrame([(t,) for t in [*TEXTS * 5, None]], "text string"), "text")


ALIKE = ("A\u0410\u0391\u13aa", "B\u0412\u0392", "C\u0421", "E\u0415\u0395", "H\u041d\u0397", "M\u041c\u039c", "O\u041e\u039f\u0555", "P\u0420\u03a1", "T\u0422\u03a4", "a\u0430", "c\u0441", "e\u0435", "i\u0456", "o\u043e\u03bf\u0585", "p\u0440", "s\u0455", "x\u0445", "\u0443y")


def disguise(text, seed):
    r, out = random.Random(seed), []
    by = {x: [y for y in row if y != x] for row in ALIKE for x in row}
    for ch in unicodedata.normalize(r.choice(["NFC", "NFD"]), text):
        if ch in by and by[ch] and r.random() < 0.4:
            ch = r.choice(by[ch])
        elif "!" <= ch <= "~" and r.random() < 0.2:
            ch = chr(ord(ch) + 0xFEE0)
        elif ch == " " and r.random() < 0.5:
            ch = r.choice("\u00a0\u2007\u202f\u3000")
        out.append(ch + r.choice(["", "", "", "\u200b", "\u00ad", "\ufeff"]))
    return "".join(out).replace("ffi", "\ufb03")


def test_disguised_texts_get_one_form(model):
    to = lookalikes.Canonicaliser(model)
    for text in TEXTS:
        forms = set(to([text, *(disguise(text, s) for s in range(30))]))
        assert len(forms) == 1, forms


def test_forms_keep_the_script(model):
    to = lookalikes.Canonicaliser(model)
    assert to(["\u041e\u0441\u0442\u0430\u043d\u043e\u0432", "\u043e\u0441\u0435\u0430\u043d", "x", None, ""])[2:] == ["x", None, ""]
    assert to([TEXTS[1]]) == [TEXTS[1]] or re.search("[а-я]", to([TEXTS[1]])[0])
    assert to(["The office raised"]) == ["The office raised"]


@pytest.mark.parametrize("a,b", [("resume", "r\u00e9sum\u00e9"), ("x2", "x\u00b2"), ("x1", "x\u2460"), ("Case", "case"), ("end.", "end"), ("l1", "I1"), ("a-b", "a\u2013b"), ("one two", "onetwo")])
def test_visible_differences_stay(model, a, b):
    x, y = lookalikes.Canonicaliser(model)([a, b])
    assert x != y


def test_the_lattice_decides(spark, monkeypatch):
    """A stroke without case is an l or an I, as its neighbours say: without the search such texts are lost."""
    words = ["login allowed while pulling files", "hello world all well", "WINDOWS INFO FIRST MISSING", "INITIAL SHIFT"] * 5
    model = lookalikes.train(spark.createDataFrame([(w,) for w in words], "text string"), "text")
    texts = ["hello world", "he\u01c0\u01c0o wor\u01c0d", "WINDOWS INFO", "W\u01c0NDOWS \u01c0NFO"]
    a, b, c, d = lookalikes.Canonicaliser(model)(texts)
    assert a == b == texts[0] and c == d == texts[2]
    monkeypatch.setattr(lookalikes.Model, "viterbi", lambda self, lattices: [[row[0] for row in rows] for rows in lattices])
    a, b, c, d = lookalikes.Canonicaliser(model)(texts)
    assert a != b or c != d


def test_tokens_of_all_planes():
    texts = ["cafe\u0301 r\u00e9sum\u00e9-2x\u00b2 \u0434\u0430_a", "x\U0001d7d8 \U00010428\U00010429a b", "plain", ""]
    tokens = lookalikes.tokens_and_ends(texts)
    assert tokens == ["cafe\u0301", "r\u00e9sum\u00e9", "x", "\u0434\u0430", "a", "\x00", "x", "\U00010428\U00010429a", "b", "\x00", "plain", "\x00", "\x00"]
    assert lookalikes.tokens_and_ends(texts[:1]) == tokens[:6]  # by another class of letters, to the same tokens


def test_readings_come_from_the_corpus(spark):
    """A Cyrillic corpus reads an ambiguous word in Cyrillic, a Latin one in Latin; both spellings get one form."""
    cyrillic = lookalikes.train(spark.createDataFrame([("\u0441\u043e\u0441\u043d\u0430 \u0440\u043e\u0441\u0430 \u043e\u0441\u0430 \u043a\u043e\u0441\u0430",)] * 9 + [("the end",)], "text string"), "text")
    latin = lookalikes.train(spark.createDataFrame([("cocoa ocean coca",)] * 9 + [("\u043d\u043e\u0447\u044c",)], "text string"), "text")
    both = ["oca", "\u043e\u0441\u0430", "\u043ec\u0430"]
    assert set(lookalikes.Canonicaliser(cyrillic)(both)) == {"\u043e\u0441\u0430"}
    assert set(lookalikes.Canonicaliser(latin)(both)) == {"oca"}


def test_members_and_split_forms(spark):
    rows = [(i, f"t{i % 40}", "f") for i in range(200)] + [(500, "u", "g"), (501, "u", "g"), (502, None, "h"), (503, "v", None)]
    keys = spark.createDataFrame(rows, "doc_id bigint, t string, f string").withColumn("n_rows", F.lit(0))
    want = {(a, b) for a, ta, fa in rows for b, tb, fb in rows if a < b and fa and fa == fb and ta and tb and ta != tb}
    for block in (1024, 7):
        got = [tuple(r) for r in lookalikes.look_alike_pairs(keys, "doc_id", "t", "f", block).collect()]
        assert len(got) == len(want) and set(got) == want
    members = {r["id"]: (r["class_id"], r["n_links"]) for r in lookalikes.look_alike_members(keys, "doc_id", "t", "f").collect()}
    assert members == {**{i: (0, 195) for i in range(200)}, 500: (500, 0), 501: (500, 0)}


def test_pairs(spark, model):
    rows = [(1, "cafe one"), (2, "c\u0430fe one"), (3, "cafe one"), (4, "cafe\u00a0one"), (5, "cafe two"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", lookalikes.consistent_form(F.col("text"), model))
    keys = df.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("t"), F.sha2("form", 256).alias("f"))
    got = sorted(map(tuple, lookalikes.look_alike_pairs(keys, "doc_id", "t", "f").collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert lookalikes.look_alike_pairs(keys.limit(0), "doc_id", "t", "f").count() == 0
    again = keys.union(spark.createDataFrame([(1, "other", keys.where("doc_id = 1").first()["f"])], keys.schema))
    assert all(r["doc_a"] < r["doc_b"] for r in lookalikes.look_alike_pairs(again, "doc_id", "t", "f").collect())
