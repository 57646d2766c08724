import io
import json

import pytest

from evidence import cli
from evidence.rules.spec import RuleError
from evidence.sources.rules import clear_cache, load_rules

NOTE = """
doc_type: note
source: {source_id: notes, table: note, key: id}
title: {field: name}
body:
  - {label: Text, value: {field: text}}
metadata:
  kind: {field: kind}
"""
GATE = """
limits: {min_words: 2}
rules:
  - {id: count, kind: needs_sql, patterns: [how many], message: A count., sql_hint: SELECT count(*)}
"""


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "rules/doc_types").mkdir(parents=True)
    (tmp_path / "rules/doc_types/note.yaml").write_text(NOTE)
    (tmp_path / "rules/qualify.yaml").write_text(GATE)
    (tmp_path / "rules/catalog.yaml").write_text("schemas: [public]\n")
    spark.createDataFrame([("a", "River stones", "smooth river stones", "x", True), ("b", "Clouds", "white clouds above", "y", True)], "id string, name string, text string, kind string, is_active boolean").write.parquet(f"{tmp_path}/source/note.parquet")
    spark.createDataFrame([(1, "notes", "a"), (2, "notes", "b")], "change_id long, source_id string, record_key string").write.parquet(f"{tmp_path}/source/record_change.parquet")
    clear_cache()
    return ["--root", f"file://{tmp_path}/store", "--rules", f"{tmp_path}/rules", "--source", f"{tmp_path}/source"]


def test_commands(place, capsys, monkeypatch, tmp_path):
    say = lambda *a: (cli.main([*a, *place]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    assert say("rules-check")[0] == 0
    assert say("plan")[1][0].items() >= {"mode": "full", "new_documents": 2, "to_embed": 2}.items()
    assert say("ingest", "--approve-over", "1")[0] == cli.PAUSED
    assert say("approve", "note")[1][0]["status"] == "succeeded"  # approved, and embedded
    assert say("embed")[0] == 0
    assert say("ingest")[1][0]["status"] == "nothing"
    status = say("status")[1][0]
    assert status["index"][0]["embedded"] == 2 and status["behind"] == [{"doc_type": "note", "source_id": "notes", "behind": 0}]
    assert [b["doc_type"] for b in status["batches"]] == ["note"]
    assert say("ingest", "--loop", "--interval", "0")[0] == 0
    assert say("history", "note:a")[1][0]["version"] == 1
    assert say("qualify", "how many stones")[1][0]["rule_id"] == "count"
    assert say("qualify", "stones")[1][0]["rule_id"] == "limit:min_words" and say("qualify", "stones", "--follow-up")[1][0]["decision"] == "pass"
    hits = say("search", "river stones", "--filter", "kind=x")[1]
    assert [h["doc_id"] for h in hits] == ["note:a"]
    assert say("catalog", "--stored") == (cli.FAILED, [])
    assert say("catalog")[1][0]["tables"]["note"].items() >= {"key": ["id"], "rows": 2}.items()
    assert say("catalog", "--stored")[1][0]["tables"]["note"]["key"] == ["id"]
    assert say("ask", "how many stones are there")[1][0]["decision"] == "needs_sql"
    got = say("ask", "which river stones are smooth", "--filter", "kind=x")[1][0]
    assert [s["doc_id"] for s in got["sources"]] == ["note:a"] and got["cited"] == [1]
    vague = say("ask", "stones")[1][0]
    assert vague["decision"] == "clarify" and say("resume", "which river stones are smooth", "--pause", vague["pause"])[1][0]["decision"] == "pass"
    assert say("feedback", got["query_id"], "--verdict", "bad")[0] == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("where are white clouds\n\nand the stones\n"))
    assert [r["turn"] for r in say("chat", "--thread", got["thread"])[1]] == [2, 3]
    assert [c["turns"] for c in say("conversations")[1]] == [1, 3, 1] and len(say("conversations", "--limit", "2")[1]) == 2
    say("catalog", "--export", f"{tmp_path}/catalog.yaml")
    assert "note:" in (tmp_path / "catalog.yaml").read_text()


def test_rule_files(place, tmp_path):
    rules = load_rules(f"{tmp_path}/rules")
    assert [r.doc_type for r in rules.resolve("")] == ["note"] == [r.doc_type for r in rules.resolve("note,note")]
    with pytest.raises(RuleError):
        rules.resolve("other")
    (tmp_path / "rules/doc_types/other.yaml").write_text(NOTE)
    with pytest.raises(RuleError):
        load_rules(f"{tmp_path}/rules")
    (tmp_path / "rules/doc_types/other.yaml").write_text("!!python/object:os.system {}")
    with pytest.raises(Exception):  # noqa: B017  tags are not executed
        load_rules(f"{tmp_path}/rules")
