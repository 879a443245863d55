"""Queries of the problems p6 to p9, over the alerts and documents tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.keys import present, trimmed
from siltstone.llm import lookalikes, mixing, packing, runs
from siltstone.llm.tokens import token_count, token_ids
from siltstone.session import spread, table, write_read

RUN_GAP_US = 300_000_000
#: Container specs and mixing targets are settings that come to the driver; more rows than this are an error.
MOST_SETTINGS = 10_000


def _settings(df: DataFrame) -> list:
    rows = df.limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError("too many settings")
    return rows


def _rule_key(rule: Column) -> Column:
    return F.regexp_replace(F.upper(rule), "[^A-Z0-9]+", "")


def _process_key(uid: Column) -> Column:
    return present(F.upper(trimmed(F.regexp_replace(trimmed(uid), r"^\{+|\}+$", ""))))


def _runs(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    rules = table(spark, sf_dir, "detection_rules").where(F.col("rule_id").isNotNull())
    rules = rules.groupBy(_rule_key(F.col("rule_id")).alias("key")).agg(F.min("rule_id").alias("rule_id"))
    alerts = table(spark, sf_dir, "alerts").select("id", F.unix_micros("ts").alias("at_us"), _process_key(F.col("process_uid")).alias("process_uid"), _rule_key(F.col("rule_id")).alias("key"))
    found = runs.collapse_runs(alerts.join(rules, "key", "left"), "process_uid", "rule_id", "id", "at_us", RUN_GAP_US, least)
    return found.select(
        F.col("entity").alias("process_uid"), F.col("kind").alias("rule_id"), "first_id", "last_id", F.col("n_events").alias("n_alerts"), (F.col("last_us") - F.col("first_us")).alias("duration_us")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, 2)


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert sequence with its runs collapsed, single alerts included."""
    return _runs(spark, sf_dir, 1)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", mixing.source_key(F.col("source")).alias("source"), token_count(F.col("text")).alias("n"))


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return [(r["spec_id"], r["capacity_tokens"]) for r in _settings(table(spark, sf_dir, "pack_specs").where("spec_id is not null and capacity_tokens > 0"))]


def _packing(spark: SparkSession, sf_dir: str) -> packing.Packing:
    return packing.pack(_sized(spark, sf_dir), "doc_id", "n", _specs(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for every spec."""
    packed = _packing(spark, sf_dir).pieces
    return packed.select("spec_id", F.col("item_id").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), "container")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_packing(spark, sf_dir), _specs(spark, sf_dir))


def p7_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each round of packing and exchange did, by spec."""
    return _packing(spark, sf_dir).rounds


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must hold, by spec: documents packed, containers overfull, documents split that fit, pieces that do not join."""
    capacity = F.create_map(*(F.lit(x) for s, c in _specs(spark, sf_dir) for x in (s, c)))[F.col("spec_id")]
    rows = write_read(p7_containers(spark, sf_dir), "containers")
    full = rows.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n")).groupBy("spec_id").agg(F.count_if(F.col("n") > capacity).alias("n_overfull"))
    docs = rows.groupBy("spec_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"))
    docs = docs.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= capacity)).alias("n_split_in_vain"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("starts") != F.col("n"))).alias("n_not_joining")
    )
    return docs.join(full, "spec_id")


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int], dict[str, tuple[float, int]], DataFrame]:
    """The targets' sources cut into blocks, their tokens, the targets, and the targets as a table."""
    wanted = table(spark, sf_dir, "mix_targets").select(mixing.source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    wanted = wanted.where("source is not null and target_share is not null and max_repeats is not null")
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in _settings(wanted)}
    items = write_read(_sized(spark, sf_dir).where("n > 0").where(F.col("source").isin(list(targets))), "sized")
    sums = items.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    blocks = mixing.lay_out(items, mixing.BLOCK_TOKENS, {r["source"]: r["docs"] for r in sums})
    return blocks, {r["source"]: r["n"] for r in sums}, targets, wanted


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks, tokens, targets, wanted = _laid_out(spark, sf_dir)
    return mixing.mix(blocks, tokens, targets), wanted


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats and the tokens taken of them."""
    return mixing.document_uses(_mixture(spark, sf_dir)[0])


def p8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: the pieces of documents in every slot of every shard."""
    return _mixture(spark, sf_dir)[0]


def p8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture written out: the tokens in every slot of every shard."""
    blocks, tokens, targets, _ = _laid_out(spark, sf_dir)
    blocks = write_read(blocks, "blocks")
    return mixing.token_blocks(mixing.mix(blocks, tokens, targets), blocks, table(spark, sf_dir, "documents"), token_ids(F.col("text")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mixture_shares(*_mixture(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every mixture must hold, by source: repeats within the limit, the share met to two blocks among the sources there are."""
    rows = write_read(p8_shares(spark, sf_dir), "shares")
    sums = rows.agg(F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).alias("share")).first()
    goal = F.when(F.col("n_tokens") > 0, F.col("target_share") / F.lit(sums["share"])).otherwise(0.0)
    met = F.abs(F.col("n_tokens") - goal * F.lit(sums["tokens"])) <= 2 * mixing.BLOCK_TOKENS
    return rows.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_met"), met.alias("share_met"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null and text <> ''"))
    model = lookalikes.train(docs, "text")
    return docs.withColumn("form", lookalikes.consistent_form(F.col("text"), model))


def _form_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _forms(spark, sf_dir).select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"), F.unhex(F.sha2("form", 256)).alias("form_key"))
    return write_read(keys, "forms")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_form_keys(spark, sf_dir), "doc_id", "text_key", "form_key")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with a text: its class of equal looks and its number of links."""
    members = lookalikes.look_alike_members(_form_keys(spark, sf_dir), "doc_id", "text_key", "form_key")
    return members.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its consistent form."""
    return _forms(spark, sf_dir).select("doc_id", "form")


QUERIES = {
    "p6_found": p6_found,
    "p6_collapsed": p6_collapsed,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p7_rounds": p7_rounds,
    "p7_invariants": p7_invariants,
    "p8_documents": p8_documents,
    "p8_blocks": p8_blocks,
    "p8_token_blocks": p8_token_blocks,
    "p8_shares": p8_shares,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_forms": p9_forms,
}

_RUNS = f"""with rules as (
  select regexp_replace(upper(rule_id), '[^A-Z0-9]+', '', 'g') key, min(rule_id) rule_id from detection_rules group by 1),
seq as (
  select a.id, epoch_us(a.ts) at_us, nullif(nullif(upper(trim(trim(a.process_uid, ' {{}}'))), ''), '-') process_uid, r.rule_id
  from alerts a left join rules r on regexp_replace(upper(a.rule_id), '[^A-Z0-9]+', '', 'g') = r.key),
marked as (
  select *, case when rule_id = lag(rule_id) over w and at_us - lag(at_us) over w <= {RUN_GAP_US} then 0 else 1 end new
  from seq where process_uid is not null and at_us is not null window w as (partition by process_uid order by at_us, id)),
numbered as (select *, sum(new) over (partition by process_uid order by at_us, id rows unbounded preceding) no from marked)
select process_uid, rule_id, arg_min(id, (at_us, id)) first_id, arg_max(id, (at_us, id)) last_id, count(*)::bigint n_alerts, (max(at_us) - min(at_us))::bigint duration_us
from numbered where rule_id is not null group by process_uid, rule_id, no"""

# The letters of the test tables that look like others, written out for the SQL alone.
_LIKE, _LATIN = "АВЕКМНОРСТУХІЅЈԌаеорсухіјѕԁһӏԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXISJGaeopcyxijsdhlqwvABEZHIKMNOPTYXo"


def _form_sql(text: str) -> str:
    """A text as it looks, in SQL: each letter shape by one letter."""
    wide = "".join(chr(n + 0xFEE0) for n in range(0x21, 0x7F) if n != 0x27)
    narrow = "".join(chr(n) for n in range(0x21, 0x7F) if n != 0x27)
    blanks = "\t" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
    out = f"regexp_replace({text}, '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g')"
    for joined, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\uff07", "''")):
        out = f"replace({out}, '{joined}', '{letters}')"
    out = f"translate({out}, '{wide}{blanks}\u212a', '{narrow}{' ' * len(blanks)}K')"
    # Accents are taken apart from no letter: those of other scripts' letters are composed after the exchange.
    return f"nfc_normalize(translate({out}, '{_LIKE}', '{_LATIN}'))"


_PAIRS = f"""with forms as (select doc_id, text, {_form_sql("text")} form from documents where text <> '')
select a.doc_id doc_a, b.doc_id doc_b from forms a join forms b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"""

_CLASSES = f"""with forms as (select doc_id, text, {_form_sql("text")} form from documents where text <> ''), t as (select form, text, count(*) own from forms group by all),
c as (select form, min(doc_id) class_id, count(*) n from forms group by form)
select doc_id, class_id, (n - own)::bigint n_links from forms join t using (form, text) join c using (form)"""

_PACKED = """select spec_id, (select count(*) from documents where text <> '') n_docs, 0::bigint n_split_in_vain, 0::bigint n_not_joining, 0::bigint n_overfull from pack_specs where capacity_tokens > 0"""

_MIXED = r"select regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') source, true repeats_met, true share_met from mix_targets"

ORACLES = {"p7_invariants": _PACKED, "p8_invariants": _MIXED, "p9_found": _PAIRS, "p9_classes": _CLASSES, "p6_found": f"select * from ({_RUNS}) where n_alerts >= 2", "p6_collapsed": _RUNS}
