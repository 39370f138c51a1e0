"""The command line, on one small document."""

import json

import pytest

from assaykit import cli
from assaykit.plans import runs

DOC = {"doc_id": "d1", "title": "t", "year": 2020, "license": "MIT", "tables": [{"id": "T1", "caption": "Collected after 24 h", "columns": ["Sample", "Yield (%)"], "rows": [{"Sample": "Alpha", "Yield (%)": "5"}, {"Sample": "Beta", "Yield (%)": "7"}]}]}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "d1.json").write_text(json.dumps(DOC))
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"path": "sub/../d1.json", "expected": {"candidates": 2, "gold": 2, "silver": 1}, "expected_claims": [{"kind": "table", "table_id": "T1", "row": "Alpha", "col": "Yield (%)", "value": "5"}]}]}))
    said = lambda *words: (cli.main([str(w) for w in words], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])[1]
    said("run", "--paths", tmp_path / "d1.json", "--out", tmp_path / "out")
    (summary,) = said("summary", "--results", tmp_path / "out")
    assert (summary["documents"], summary["candidates"], summary["gold"]) == (1, 2, 2)
    (found,) = said("ask", "--results", tmp_path / "out", "--question", "yield of Beta", "--limit", "1")
    assert found["entity"] == "Beta"
    (score,) = said("evaluate", "--manifest", tmp_path / "m.json", "--strategies", "table_only", "--out", tmp_path / "eval")
    assert (score["claim_recall"], score["claim_precision"], score["candidates_accuracy"], score["silver_accuracy"]) == (1.0, 0.5, 1.0, 0.0)
    with pytest.raises(SystemExit):
        cli.main(["run"], spark)


def test_inputs_are_found_again(tmp_path):
    (tmp_path / "a.json").write_text("{}")
    assert runs.resolve(["gone/a.json", "s3://b/c"], [str(tmp_path)]) == [str(tmp_path / "a.json"), "s3://b/c"]
    with pytest.raises(FileNotFoundError):
        runs.resolve(["gone/b.json"], [str(tmp_path)])
