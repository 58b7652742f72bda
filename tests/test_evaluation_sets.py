"""Published quality figures, from evaluation sets in a folder that MNEMOSPARK_EVALUATION_SETS names."""

import json
import os

import pytest

from mnemospark.functions import text
from mnemospark.operators import metrics
from mnemospark.sources import evaluation_sets

FOLDER = os.environ.get("MNEMOSPARK_EVALUATION_SETS", "")
needs_sets = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no evaluation sets here")


@needs_sets
def test_lexical_figures(spark):
    data = evaluation_sets.lexical_set(spark, f"{FOLDER}/lexical.json")
    assert data.records.count() == 258 and data.queries.count() == 30
    modes = {"legacy": evaluation_sets.scored(data, text.tokenize_runs), "cjk_bigram": evaluation_sets.scored(data, text.tokenize)}
    got = {r["mode"]: (r.recall5, r.recall10, r.reciprocal) for r in metrics.mode_report(modes, data.queries.select("query_id", "bucket")).filter("bucket IS NULL").collect()}
    assert got == {"legacy": (0.25, 0.25, 0.25), "cjk_bigram": (1.0, 1.0, 0.979167), "delta": (0.75, 0.75, 0.729167)}
    checks = metrics.hard_checks(evaluation_sets.ranked(data, text.tokenize), data.forbidden).agg({"forbidden_hits": "sum", "duplicate_ids": "sum"}).first()
    assert tuple(checks) == (0, 0)


@needs_sets
def test_embedding_figures(spark):
    data = evaluation_sets.embedding_set(spark, f"{FOLDER}/embedding.json")
    assert data.records.count() == 35 and data.queries.count() == 26
    rows = metrics.by_cells(evaluation_sets.scored(data, text.tokenize_runs), data.queries.select("query_id", "bucket", "language"), [["bucket"], ["bucket", "language"]])
    got = {(r.bucket, r.language): (r.recall5, r.recall10, r.reciprocal) for r in rows.collect()}
    assert got[("synonym", None)] == (0.3, 0.5, 0.215119) and got[("synonym", "zh")] == (0.2, 0.3, 0.139286) and got[("synonym", "en")] == (0.4, 0.7, 0.290952) and got[("exact", None)] == (1, 1, 1)


def test_expansion_of_a_small_set(spark, tmp_path):
    owner = {"tenantId": "t", "userId": "u", "agentId": "a"}
    codes = {d: [f"{d[0]}1", f"{d[0]}2"] for d in evaluation_sets.DISTRACTORS}
    group = {"id": "g", "owner": owner, "sourceSessionId": "s", "records": [{"id": "r1", "content": "green tea"}], "sharedInterference": [{"id": "r2", "content": "red door"}], "distractorCodes": codes, "distractorIds": {d: [f"{d}-{i}" for i in (1, 2)] for d in codes}, "queries": [{"id": "q1", "bucket": "short_term", "split": "baseline", "query": "tea", "relevantIds": ["r1"]}]}
    hidden = {"id": "f1", "owner": owner, "sourceSessionId": "s", "content": "tea gone", "status": "active", "visibility": "recallable", "validUntil": "2025-01-01T00:00:00.000Z"}
    asked = {"id": "q2", "owner": owner, "sessionId": "s", "sessionOnly": True, "query": "tea gone", "forbiddenIds": ["f1"]}
    path = tmp_path / "set.json"
    path.write_text(json.dumps({"evaluationTime": "2025-02-01T00:00:00.000Z", "groups": [group], "filterRecords": [hidden], "filterQueries": [asked]}))
    data = evaluation_sets.lexical_set(spark, str(path))
    assert {r.memory_id.split("-", 1)[1]: r.content for r in data.records.collect()} == {"r1": "green tea", "r2": "red door", "f1": "tea gone", **{f"{d}-{i}": f"{d[0]}{i}" for d in codes for i in (1, 2)}}
    got = evaluation_sets.ranked(data, text.tokenize).collect()
    assert {(r.query_id, r.rank, r.memory_id) for r in got} == {("q1", 1, "000000-r1"), ("q2", 1, "000000-r1")}
    assert evaluation_sets.scored(data, text.tokenize).first().reciprocal == 1
