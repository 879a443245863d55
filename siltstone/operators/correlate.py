"""Correlation of alerts into clusters: edges within time windows, then connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltstone.functions.normalize import is_correlating_user, is_ignorable_ip, is_machine_account
from siltstone.session import drop_written, write_read

# Fixed values, seconds.
PROCESS_S, USER_S, IP_S, FILE_S, MACHINE_S = 900, 1800, 1800, 3600, 120
US = 1_000_000


def chain_edges(rows: DataFrame, key: str, window_s: int) -> DataFrame:
    """Edges (a, b) between neighbours in time of one key at most window_s apart.

    They connect the same rows as all pairs within the window would. rows: id, at_us and key; a null
    key makes no edge. Rows of a key lying in one cell of the window are joined to the cell's first
    before ordering, so what one task orders per key is bounded by the time range.
    """
    whole = rows.where(F.col(key).isNotNull()).select(key, "id", "at_us", F.floor(F.col("at_us") / F.lit(window_s * 1_000_000)).alias("_c"))
    cells = whole.groupBy(key, "_c").agg(F.min(F.struct("at_us", "id")).alias("_lo"), F.max(F.struct("at_us", "id")).alias("_hi"))
    inside = whole.join(cells.select(key, "_c", F.col("_lo.id").alias("a")), [key, "_c"]).where("a <> id").select("a", F.col("id").alias("b"))
    line = Window.partitionBy(key).orderBy("_c")
    between = cells.select(F.lag("_hi").over(line).alias("_p"), "_lo").where(F.col("_lo.at_us") - F.col("_p.at_us") <= window_s * 1_000_000)
    return inside.unionByName(between.select(F.col("_p.id").alias("a"), F.col("_lo.id").alias("b")))


def band_edges(left: DataFrame, right: DataFrame, key: str, over_us: int, up_to_us: int) -> DataFrame:
    """Edges (a, b) that connect the same rows as all pairs with over_us < right time - left time <= up_to_us.

    A left row covers an interval of right rows. It is tied to the first of them, and neighbouring
    right rows are tied to each other where one left row covers both; the latest one before them
    decides. Each row lies in two cells as long as the interval, so a hot key is spread over time and
    the number of edges is linear in the rows.
    """
    span = up_to_us - over_us

    def placed(df: DataFrame, at: Column, is_left: int) -> DataFrame:
        cell = F.floor(at / F.lit(span))
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "id", at.alias("t"), F.lit(is_left).alias("l"), F.explode(F.array(cell, cell + 1)).alias("c"))

    rows = placed(left, F.col("at_us") + over_us, 1).unionByName(placed(right, F.col("at_us"), 0))
    # At equal times right rows come first: they lie outside an interval that opens after its start.
    line = Window.partitionBy("k", "c").orderBy("t", "l", "id")
    last_left = F.last(F.when(F.col("l") == 1, F.col("t")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    right_row = F.when(F.col("l") == 0, F.struct("t", "id"))
    follower = F.first(right_row, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    tied = rows.withColumns({"s": last_left, "n": follower}).where(F.col("n.t") <= F.col("s") + span)
    return tied.select(F.col("id").alias("a"), F.col("n.id").alias("b")).where("a <> b")


def alert_edges(alerts: DataFrame, documented: bool = False) -> DataFrame:
    """Edges between alerts: id, rule_id, ts, host, user_norm, process_uid, file_path, src_ip, dst_ip.

    Same process within 900 s; same telling user or a shared telling address within 1,800 s; same host
    within 120 s of remote management by the host's own machine account; same file between 1,800 and
    3,600 s (up to 3,600 s, and same host within 1,800 s, where documented).
    """
    rows = alerts.withColumn("at_us", F.unix_micros("ts")).where("id is not null and at_us is not null")
    user = rows.withColumn("_k", F.when(is_correlating_user(F.col("user_norm")), F.col("user_norm")))
    peers = F.array_distinct(F.filter(F.array("src_ip", "dst_ip"), lambda x: x.isNotNull() & ~is_ignorable_ip(x)))
    ips = rows.select("id", "at_us", F.explode(peers).alias("_k"))
    own = (F.col("rule_id") == "CUR-021") & is_machine_account(F.col("user_norm")) & (F.upper(F.rtrim(F.regexp_replace("user_norm", r"\$$", ""))) == F.col("host"))
    machine = rows.where(F.coalesce(own, F.lit(False)))
    edges = [chain_edges(rows, "process_uid", PROCESS_S), chain_edges(user, "_k", USER_S), chain_edges(ips, "_k", IP_S)]
    back = F.negative("at_us").alias("at_us")
    edges.append(band_edges(machine, rows, "host", -1, MACHINE_S * US))
    edges.append(band_edges(machine.select("id", "host", back), rows.select("id", "host", back), "host", -1, MACHINE_S * US))
    if documented:
        edges += [chain_edges(rows, "file_path", FILE_S), chain_edges(rows, "host", USER_S)]
    else:
        edges.append(band_edges(rows, rows, "file_path", USER_S * US, FILE_S * US))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id of each connected component.

    Alternating steps hang every node's larger neighbours, then its smaller ones, on its least
    neighbour; the number of rounds grows with the logarithm of the component size, not with its
    diameter. Each round is written to the shared folder, which bounds the lineage; only a count of
    changes comes to the driver. The neighbours of a node are never gathered in a list, the least is
    found with map-side combination.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, signature = write_read(both, "edges"), None
    for _ in range(max_rounds):
        # Large star: of u's neighbours and u itself, the least m; neighbours above u hang on m.
        turned = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = turned.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = turned.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Done when the set of edges stays the same: compared by count and order-free hashes, taken as it is written.
        seen, old = Observation(), state
        hashes = F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")
        state = write_read(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), *hashes), "edges")
        drop_written(old)
        row = seen.get
        row = (row["n"], row["h"], row["s"])
        if row == signature:
            break
        signature = row
    else:
        raise RuntimeError("components did not settle")
    label = state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_m"))
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("_m", "id").alias("component"))


def correlate(alerts: DataFrame, documented: bool = False) -> DataFrame:
    """(id, component) of all alerts: canonical ones by their edges, duplicates with their canonical one."""
    duplicate = F.coalesce(F.col("is_duplicate"), F.lit(False))
    canonical = alerts.where(~duplicate)
    parts = connected_components(canonical, alert_edges(canonical, documented))
    copies = alerts.where(duplicate).select("id", "canonical_id")
    attached = copies.join(parts.withColumnRenamed("id", "canonical_id"), "canonical_id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return parts.unionByName(attached)


def keyed_sessions(rows: DataFrame, key: Column, ts: str, gap_s: int) -> DataFrame:
    """Where only one key is in play, clusters are sessions: key, start, end, n."""
    out = rows.groupBy(key.alias("key"), F.session_window(ts, f"{gap_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.drop("w")
