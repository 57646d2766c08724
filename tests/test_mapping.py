import datetime
import hashlib
import json

import pytest

from evidence.operators import mapping
from evidence.rules.spec import DocType, RuleError, Value

RULE = {
    "doc_type": "thing",
    "source": {"source_id": "s", "schema": "shop", "table": "thing", "key": "code"},
    "children": {"tags": {"schema": "shop", "table": "tag", "join": {"code": "code"}, "select": "tag", "order_by": "seq"}},
    "title": {"coalesce": [{"template": "Thing {code} - {firm}"}, {"template": "Thing {code} - unknown firm"}]},
    "body": [
        {"label": "Firm", "value": {"coalesce": [{"field": "firm"}, {"const": "unknown firm"}]}},
        {"label": "Where", "value": {"coalesce": [{"join": ["city", "state"]}, {"field": "country"}]}},
        {"label": "Tags", "value": {"field": "tags"}},
        {"label": "Units", "value": {"field": "units", "format": "thousands"}},
        {"label": "On", "value": {"field": "day", "format": "iso"}},
    ],
    "url": {"field": "url"},
    "metadata": {"firm": {"field": "firm"}, "year": {"field": "day", "format": "year"}, "tags": {"field": "tags"}, "day": {"field": "day", "format": "iso"}},
    "quality": [{"rule": "not_null", "column": "note"}],
}
SCHEMA = "code string, firm string, city string, state string, country string, units long, day date, url string, note string, is_active boolean"
#: What each column may hold; rows take the values round robin with strides that have no common factor.
CHOICES = {
    "firm": ["Harbour Ltd", None, "\t", "\x1c Padded Co ", "Đồ chơi – ß"],
    "city": ["Lund", "", None],
    "state": [None, "SK"],
    "country": ["Sweden", " ", None],
    "units": [1_234_567, 0, None, 1, -4_000, 999],
    "day": [datetime.date(2023, 11, 30), None],
    "url": ["https://example.org/x", "  ", None],
    "note": ["n"],
    "is_active": [True, False, None],
}
ROWS = [{"code": f"K{i}", **{c: options[(i * (k + 1) + k) % len(options)] for k, (c, options) in enumerate(CHOICES.items())}} for i in range(90)]
TAGS = [("late", 9), (None, 1), ("early", 2), (" ", 5)]


def expected(row, tagged):
    """The document of a row, in plain Python."""
    clean = {c: str(x).strip() if x is not None else "" for c, x in row.items()}
    firm = clean["firm"] or "unknown firm"
    place = ", ".join(filter(None, (clean["city"], clean["state"]))) or clean["country"]
    units = f"{row['units']:,}" if row["units"] else ""
    told = {"Firm": firm, "Where": place, "Tags": "early, late" if tagged else "", "Units": units, "On": clean["day"]}
    body = "\n".join(f"{label}: {x}" for label, x in told.items() if x)
    title = f"Thing {row['code']} - {firm}"
    metadata = {"day": clean["day"] or None, "year": row["day"] and row["day"].year, "firm": row["firm"], "tags": ["early", " ", "late"] if tagged else None}
    return title, body, clean["url"] or None, {k: x for k, x in metadata.items() if x is not None}


def test_documents_of_many_rows(spark):
    parent = spark.createDataFrame([tuple(row.get(c.split()[0]) for c in SCHEMA.split(", ")) for row in ROWS], SCHEMA)
    tags = spark.createDataFrame([(row["code"], tag, at) for row in ROWS[::2] for tag, at in TAGS], "code string, tag string, seq int")
    rule = DocType.of(RULE)
    got = {r["record_key"]: r for r in mapping.build_documents(rule, mapping.source_rows(rule, parent, {"tags": tags})).collect()}
    assert len(got) == len(ROWS)
    for i, row in enumerate(ROWS):
        title, body, url, metadata = expected(row, i % 2 == 0)
        r = got[row["code"]]
        assert (r["title"], r["body"], r["url"], json.loads(r["metadata"])) == (title, body, url, metadata), row
        assert r["content_hash"] == r["tracked_hash"] == hashlib.sha256(f"{title}\n{body}".encode()).hexdigest()
        assert r["doc_id"] == f"thing:{row['code']}" and r["is_active"] is bool(row["is_active"])


def test_thousands_of_what_is_no_number(spark):
    rows = spark.createDataFrame([(float("nan"), "x"), (float("inf"), "1e3"), (1e30, None), (-1234.9, "12345"), (0.4, "0")], "d double, s string")
    make = mapping.Compiler(rows.schema)
    got = rows.select(make.formatted("d", "thousands"), make.formatted("s", "thousands")).collect()
    assert [r[0] for r in got] == [None, None, None, "-1,234", None]
    assert [r[1] for r in got][3:] == ["12,345", None]


def test_quality_columns_are_read_even_if_no_value_needs_them():
    assert "note" in DocType.of(RULE).columns() and "tags" not in DocType.of(RULE).columns()


def test_distinct_and_filtered_children(spark):
    child = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, "b", None), (1, None, "x"), (2, "c", "y")], "k int, v string, role string")
    of = lambda **more: DocType.of({**RULE, "children": {"c": {"table": "c", "join": {"k": "id"}, "select": "v", **more}}}).children["c"]
    get = lambda spec: {r["id"]: sorted(r["items"]) for r in mapping.child_collection(child, spec).collect()}
    assert get(of(distinct=True)) == {1: ["a", "b"], 2: ["c"]}
    assert get(of(where={"column": "role", "eq": "x"})) == {1: ["b"]}
    assert get(of(where={"column": "role", "ne": "x"})) == {1: ["a"], 2: ["c"]}  # null is not different


@pytest.mark.parametrize("bad", [{"field": "a", "const": "b"}, {}, {"field": "a", "format": "roman"}, {"fild": "a"}])
def test_a_value_has_one_source(bad):
    with pytest.raises(RuleError):
        Value.of(bad)


@pytest.mark.parametrize("change", [{"body": []}, {"surprise": 1}, {"scd2": {"track": []}}, {"scd2": {"track": ["title"], "overwrite": ["title"]}}, {"quality": [{"rule": "allowed_values", "column": "a"}]}, {"children": {"c": {"table": "t", "join": {}, "select": "v"}}}])
def test_rules_that_cannot_be_right(change):
    with pytest.raises(RuleError):
        DocType.of({**RULE, **change})


def test_digest_leaves_out_checks_and_history():
    a, b, c = DocType.of(RULE), DocType.of({**RULE, "quality": [], "scd2": {"track": ["title"]}}), DocType.of({**RULE, "title": {"const": "x"}})
    assert a.digest == b.digest != c.digest and a.signature(1600, 200) != a.signature(400, 60)
