"""The entry points, from records to scores."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.casebook import SENTENCES, TRUTH, CaseBook
from siltstone.operators import validate


def record(i, **more):
    base = {"Channel": "Microsoft-Windows-Sysmon/Operational", "EventID": 1, "UtcTime": f"2024-02-05 12:{i:02d}:00.000", "EventTime": f"2024-02-05 08:{i:02d}:00", "Hostname": "pc1.x", "User": "D\\ann", "ProcessGuid": "{A}", "ProcessId": "7", "Image": "C:\\Windows\\notepad.exe"}
    return json.dumps({**base, **more})


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    book = CaseBook(spark, str(tmp_path_factory.mktemp("case")))
    lines = [
        record(1, Image="C:\\ProgramData\\a.exe", ParentImage="C:\\o\\winword.exe"), record(2, Image="C:\\w\\powershell.exe", CommandLine="powershell -enc AA", ParentImage="C:\\o\\winword.exe"),
        record(3, Image="C:\\w\\whoami.exe"), record(4), record(59, Hostname="pc9", User="D\\zoe", ProcessGuid="{Z}", Image="C:\\w\\whoami.exe"), "{broken",
    ]
    rows = spark.createDataFrame([(f"d/{i}", t) for i, t in enumerate(lines)], "uid string, raw string")
    assert book.seed(rows) == {"sysmon": 5, "skipped": 1}
    assert book.seed(rows) == {"skipped": 6}
    book.counts = book.run()
    return book


def test_run_and_list(book):
    assert book.counts == {"alerts": 5, "incidents": 2}
    first = book.incidents().collect()
    assert [(r["hosts"], r["status"], r["title"], r["event_count"]) for r in first] == [(["PC1"], "open", f"Incident #{first[0]['id']} (PC1)", 4)]
    assert book.incidents(True).count() == 2
    ids = {tuple(r["hosts"]): r["id"] for r in book.incidents(True).collect()}
    assert book.run() == book.counts and {tuple(r["hosts"]): r["id"] for r in book.incidents(True).collect()} == ids
    assert book.audit_status().first()[:] == (True, 2, None)


def test_one_incident_and_its_evidence(book):
    number = book.incidents().first()["id"]
    parts = book.incident(number)
    assert [r["position"] for r in parts["timeline"].orderBy("position").collect()] == [1, 2, 3]
    assert ("user", "d\\ann") in {(r["kind"], r["value"]) for r in parts["entities"].collect()} and parts["edges"].count() > 0
    got = {r["id"]: (r["reason"], r["raw"]) for r in book.evidence([1, 4, 5, 999], number).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "alerting", 4: "same_process_60s", 5: "alerting"} and got[4][1] == record(4)
    assert {r["id"]: r["reason"] for r in book.evidence([4]).collect()} == {4: "context"}
    with pytest.raises(KeyError):
        book.incident(12345)


def test_sentences_verdicts_scores_and_challenge(spark, book):
    number = book.incidents().first()["id"]
    book.store("sentences", spark.createDataFrame([(1, number, 1, "a", [1], "T1059.001"), (2, number, 2, "b", [], "T1204"), (3, number, 3, "c", [2], "T1033")], SENTENCES))
    book.store("truth", spark.createDataFrame([("T1059",), ("T1547",)], TRUTH))
    answer = json.dumps([{"seq": 1, "supported": True, "reason": "seen"}, {"seq": 3, "supported": False}])
    assert {r["sentence_id"]: r["supported"] for r in book.verify(validate.dry_run({}, answer), number).collect()} == {1: True, 2: False, 3: False}
    assert book.verify(validate.dry_run({}, answer)).count() == 3 and book.table("verdicts").count() == 3
    assert [(r["seq"], r["supported"]) for r in book.incident(number)["sentences"].collect()] == [(1, True), (2, False), (3, False)]
    scores = book.scores()
    assert scores["numbers"].select("n_recovered", "n_related", "precision", "recall").first()[:] == (1, 1, 1.0, 0.5)
    assert {r["id"] for r in scores["not_in_evidence"].collect()} == {"T1204", "T1033"} and [r["id"] for r in scores["missed"].collect()] == ["T1547"]
    out = book.challenge(number, json.dumps({"confidence_delta": -0.9, "proposed_query": {"filters": {"process_names": ["WHOAMI.exe"]}}}))
    assert (out["old_confidence"], out["new_confidence"], [r["id"] for r in out["results"].collect()]) == (0.5, 0.0, [3])
    with pytest.raises(RuntimeError):
        book.run(rebuild=True)
    assert book.run(rebuild=True, force=True)["incidents"] == 2
