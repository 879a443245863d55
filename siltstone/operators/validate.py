"""The deterministic halves of model-assisted steps; the model call itself is a function passed in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_LIMITS = (-0.5, 0.0)
DEFAULT_CONFIDENCE = 0.5
BATCH = 5


def valid_citations(cited: Column, allowed: Column) -> Column:
    """The cited ids that are in the evidence, in order; empty if none."""
    return F.coalesce(F.array_intersect(cited, allowed), F.array().cast("array<bigint>"))


def renumbered(sentences: DataFrame, group: str, seq: str) -> DataFrame:
    """Sentences with seq counted from 1 without holes in each group."""
    return sentences.withColumn(seq, F.row_number().over(Window.partitionBy(group).orderBy(seq)))


def whitelisted(claims: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Claims marked 'declined' (null, NONE, NULL), 'accepted' (among the candidates) or 'rejected'.

    The last of keys is the claimed value.
    """
    value = F.upper(F.trim(F.col(keys[-1])))
    known = candidates.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = claims.join(known, keys, "left")
    verdict = F.when(value.isNull() | value.isin("", "NONE", "NULL"), "declined").when(F.col("_known"), "accepted").otherwise("rejected")
    return out.withColumn("verdict", verdict).drop("_known")


def batch_numbers(sentences: DataFrame, group: str, seq: str, size: int = BATCH) -> DataFrame:
    """Sentences with the number of the batch they are checked in, from 0, by seq."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(seq))
    return sentences.withColumn("batch", F.floor((place - 1) / size))


def latest_verdicts(verdicts: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last verdict of every key, by time, then by tie."""
    newest = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(tie).desc())
    return verdicts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def supported_or_default(supported: Column, evidence: Column) -> Column:
    """A verdict, else whether there is any evidence."""
    return F.coalesce(supported, F.coalesce(F.size(evidence) > 0, F.lit(False)))


def updated_confidence(old: Column, change: Column) -> Column:
    """Confidence after a challenge: the change limited to [-0.5, 0], the result to [0, 1], three digits."""
    limited = F.greatest(F.lit(CHANGE_LIMITS[0]), F.least(F.lit(CHANGE_LIMITS[1]), F.coalesce(change.cast("double"), F.lit(0.0))))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(old.cast("double"), F.lit(DEFAULT_CONFIDENCE)) + limited)), 3)


def token_cost(tokens: Column, rate_per_million: Column) -> Column:
    """Tokens at a rate per million, six digits."""
    return F.round(tokens * rate_per_million / F.lit(1e6), 6)


def repair_json(text: str | None) -> list[dict]:
    """The complete objects of a list in a model's answer, also where the answer breaks off.

    Fences and text around the JSON are ignored, backslashes that escape nothing are doubled. Objects
    are read one after another from the innermost list that holds objects; nothing is invented.
    """
    if not text:
        return []
    body = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", text)
    decoder = json.JSONDecoder(strict=False)
    start = re.search(r"\[\s*\{", body)
    at = start.start() + 1 if start else body.find("{")
    out: list[dict] = []
    while 0 <= at < len(body):
        at = body.find("{", at)
        if at < 0:
            break
        try:
            value, at = decoder.raw_decode(body, at)
            out.append(value)
        except ValueError:
            at += 1
    return out


def repaired_sentences(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, place, sentence as JSON) of the answers' complete objects."""
    field = answers.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, json.dumps(o, ensure_ascii=False, sort_keys=True)) for k, a in zip(pdf[key], pdf[answer]) for i, o in enumerate(repair_json(a), 1)]
            yield pd.DataFrame(rows, columns=[key, "place", "sentence"])

    return answers.select(key, answer).mapInPandas(read, f"{key} {field}, place int, sentence string")


def with_model(batches: DataFrame, call: Callable[[list[str]], list[str]], prompt: str, answer: str = "answer") -> DataFrame:
    """batches with the answer of a model function to each prompt; the function sees a batch at a time."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(call(prompts.tolist()))

    return batches.withColumn(answer, ask(F.col(prompt)))


def dry_run(answers: dict[str, str], default: str = "[]") -> Callable[[list[str]], list[str]]:
    """A stand-in for a model: the answer of the first key that a prompt holds, in any case, else the default."""

    def call(prompts: list[str]) -> list[str]:
        return [next((a for k, a in answers.items() if k.lower() in (p or "").lower()), default) for p in prompts]

    return call
