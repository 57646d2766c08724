import pytest
from pyspark.sql import functions as F

from evidence.operators import conversation, gate, search
from evidence.rules.spec import Gate, RuleError


def test_parse_filters():
    assert search.parse_filters(["a=1", " b = true ", "c=x=y", "d=-4", "e=007"]) == {"a": 1, "b": True, "c": "x=y", "d": -4, "e": 7}
    for bad in ("a", "=1"):
        with pytest.raises(search.FilterError):
            search.parse_filters([bad])


@pytest.mark.parametrize("filters, want", [({"y": 2024}, {1, 2}), ({"y": "2024"}, {2}), ({"y": True}, {4, 5}), ({"h": "Fire"}, {3}), ({"y": 2024, "h": "x"}, set()), ({"r": 1.5}, {6})])
def test_metadata_filters_are_type_exact(spark, filters, want):
    rows = [(1, '{"y":2024}'), (2, '{"y":"2024"}'), (3, '{"h":"Fire"}'), (4, '{"y":true}'), (5, '{"y":"true"}'), (6, '{"r":1.5,"h":["Fire"]}'), (7, None), (8, "{broken")]
    df = spark.createDataFrame(rows, "id int, m string").where(search.metadata_filter(F.col("m"), filters))
    assert {r["id"] for r in df.collect()} == want


def test_fusion_ranks_and_caps(spark):
    v = spark.createDataFrame([(1, "a", 0.1), (2, "a", 0.2), (3, "a", 0.3), (4, "b", 0.4)], "chunk_id long, doc_id string, distance double")
    t = spark.createDataFrame([(4, "b", 0.9), (1, "a", 0.5)], "chunk_id long, doc_id string, score double")
    got = [(r["chunk_id"], r["matched_by"], round(r["score"], 6)) for r in search.fuse(v, t).collect()]
    assert got == [(1, "both", round(1 / 61 + 1 / 62, 6)), (4, "both", round(1 / 64 + 1 / 61, 6)), (2, "vector", round(1 / 62, 6))]


def test_unknown_terms_are_the_rarest(spark):
    stats = spark.createDataFrame([(f"w{i}", i) for i in range(12)], "lexeme string, ndoc long")
    asked = spark.createDataFrame([(f"w{i}",) for i in range(12)] + [("new",)], "lexeme string")
    got = [r["lexeme"] for r in search.rare_lexemes(stats, spark.createDataFrame([(100,)], "total long"), asked).collect()]
    assert got == ["new", "w0", "w1", "w2", "w3", "w4", "w5", "w6"]


def test_vectors_of_another_length_are_left_out(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", [1.0]), (4, "a", None)], "chunk_id long, doc_id string, embedding array<float>")
    assert [(r["chunk_id"], r["distance"]) for r in search.vector_search(rows, [1.0, 0.0]).collect()] == [(1, 0.0)]


@pytest.mark.parametrize("title, kind, want", [("FDA drug recall 1 - Acme Inc", "drug_recall", "Acme Inc"), ("FDA drug recall 1 - unknown firm", "drug_recall", None), ("No firm", "drug_recall", None), ("CPSC consumer product recall: Acme Recalls Pots Due to Fire; more", "cpsc_recall", "Pots recalled by Acme"), ("Pots.", "cpsc_recall", "Pots"), (None, "cpsc_recall", None)])
def test_subjects(spark, title, kind, want):
    df = spark.createDataFrame([(title, kind)], "t string, k string")
    assert df.select(search.title_subject(F.col("t"), F.col("k"))).first()[0] == want


RULES = Gate.of({"limits": {"min_words": 2, "max_chars": 40}, "rules": [
    {"id": "hi", "kind": "clarify", "equals_any": ["OK", "xin chào"], "message": "m"},
    {"id": "off", "kind": "reject", "patterns": ["never"], "message": "m", "enabled": False},
    {"id": "count", "kind": "needs_sql", "patterns": ["tổng số"], "message": "m", "sql_hint": "q"},
    {"id": "topic", "kind": "reject", "require_any": ["recall", "firm"], "message": "m", "skip_for_follow_up": True},
]})
ASKED = [("ok", 0, 0, False, "hi"), (" Xin  CHAO! ", 0, 0, False, "hi"), ("a", 0, 0, False, "limit:min_chars"), ("insulin", 0, 0, False, "limit:min_words"), ("why?", 0, 0, True, None), ("x " * 30, 0, 0, False, "limit:max_chars"), ("recall of it", 6, 0, False, "limit:max_filters"), ("recall of it", 0, 7, False, "limit:max_doc_types"), ("tong so recall", 0, 0, False, "count"), ("the weather today", 0, 0, False, "topic"), ("the weather today", 0, 0, True, None), ("never a recall", 0, 0, False, None), (None, 0, 0, False, "limit:min_chars")]


def test_first_match_decides(spark):
    rows = [(i, q, f, t, u) for i, (q, f, t, u, _) in enumerate(ASKED)]
    got = gate.qualify(spark.createDataFrame(rows, "i int, question string, n_filters int, n_doc_types int, is_follow_up boolean"), RULES).orderBy("i").collect()
    assert [r["rule_id"] for r in got] == [w for *_, w in ASKED]
    assert [r["decision"] for r in got if r["rule_id"] is None] == ["pass"] * 3
    assert next(r for r in got if r["rule_id"] == "count")["sql_hint"] == "q"


def test_gate_rules_that_cannot_be_right():
    for bad in ({"id": "a", "kind": "reject", "message": "m"}, {"id": "a", "kind": "odd", "message": "m", "patterns": ["x"]}):
        with pytest.raises(RuleError):
            Gate.of({"rules": [bad]})


def test_citations(spark):
    cases = [("See [1] and [2, 7].", [1, 2]), ("none", [1, 2, 3]), ("[9]", [1, 2, 3]), (None, [1, 2, 3])]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    assert [sorted(r[0]) for r in df.select(F.coalesce(conversation.mark_cited(F.col("a"), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(3)))).collect()] == [w for _, w in cases]


def test_rewrites(spark):
    rows = [("old", "new?", "Question: What is new?", []), ("old", "new?", None, []), ("old", "new?", "a sentence that was an answer before", ["Well, a sentence that was an answer before."])]
    df = spark.createDataFrame(rows, "p string, q string, r string, a array<string>")
    got = [r[0] for r in df.select(conversation.condensed(F.col("p"), F.col("q"), F.col("r"), F.col("a"))).collect()]
    assert got == ["What is new?", "old new?", "new?"]


def test_requests():
    assert conversation.parse_ask({"question": " q ", "thread": "0" * 32}, ["a"])["question"] == "q"
    for bad in ({}, {"question": "x" * 2001}, {"question": "q", "doc_types": ["b"]}, {"question": "q", "filters": dict.fromkeys("abcdef", 1)}, {"question": "q", "thread": "zz"}):
        with pytest.raises(ValueError):
            conversation.parse_ask(bad, ["a"])
    assert conversation.over_cap(5, 5) and not conversation.over_cap(5, 0)
