"""Ground truth and technique catalogues."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.parse import clean_description

TECHNIQUE = r"(\bT\d{4}(?:\.\d{3})?\b)"


def ground_truth(steps: DataFrame, dataset: str, step: str, text: str) -> DataFrame:
    """(dataset, technique_id, step, place) of the technique ids a step's text names, each once, in order."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TECHNIQUE), F.lit(1)))
    return steps.select(F.lit(dataset).alias("dataset"), F.col(step).alias("step"), F.posexplode(ids).alias("place", "technique_id"))


def techniques(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, description, tactics) of a STIX bundle's current attack patterns.

    Revoked and deprecated ones and such without an id of the catalogue are left out. An id that occurs
    twice is an error of the bundle and raises ValueError.
    """
    schema = (
        "objects array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,"
        "external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("objects").alias("o")).select("o.*")
    rows = rows.where((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    own = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    phases = F.filter(F.coalesce("kill_chain_phases", F.array()), lambda p: p["kill_chain_name"] == "mitre-attack")
    rows = rows.withColumn("id", F.try_element_at(own, F.lit(1))["external_id"]).where("id is not null")
    rows = rows.select("id", "name", clean_description(F.col("description")).alias("description"), F.transform(phases, lambda p: p["phase_name"]).alias("tactics"))
    twice = duplicates(rows, "id").first()
    if twice:
        raise ValueError(f"technique {twice['id']} occurs {twice['n']} times")
    return rows


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[dict[str, str]]:
    """The rows of a workbook's sheet (the first, if none is named) as texts by column letters; empty cells are left out.

    For catalogues of a few sheets, which are read on the driver; numbers come as they are stored.
    """
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_RELATION)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if sheet is not None and sheet not in sheets:
            raise KeyError(f"no sheet {sheet!r}; there are {sorted(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            out = {}
            for cell in row.iter(f"{_SHEET}c"):
                held = cell.find(f"{_SHEET}v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif held is None or held.text is None:
                    continue
                else:
                    text = shared[int(held.text)] if cell.get("t") == "s" else held.text
                out[cell.get("r", "").rstrip("0123456789")] = text
            if out:
                yield out


def steps_of_sheet(spark: SparkSession, path: str, step: str, text: str, sheet: str | None = None) -> DataFrame:
    """(step, text) of a workbook's rows below the header row that names the two columns."""
    rows = sheet_rows(path, sheet)
    for head in rows:
        at = {v.strip(): k for k, v in head.items()}
        if step in at and text in at:
            kept = [(r.get(at[step]), r.get(at[text])) for r in rows]
            return spark.createDataFrame(kept, "step string, text string")
    raise ValueError(f"no header row with {step!r} and {text!r}")
