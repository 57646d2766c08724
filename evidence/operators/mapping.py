"""Rows to documents: value specs compiled to column expressions, children to one aggregate and join each."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence.functions.text import blank_to_null, sha256, strip
from evidence.rules.spec import Child, DocType, Value


def _wanted(spec: Child) -> Column:
    """Whether a child row has a value that the collection takes."""
    keep = F.col(spec.select).isNotNull()
    if spec.eq:
        keep &= F.col(spec.eq[0]) == F.lit(spec.eq[1])
    if spec.ne:
        keep &= F.col(spec.ne[0]) != F.lit(spec.ne[1])
    return keep


def _items(spec: Child, keep: Column | None = None) -> Column:
    """The array of a collection, an aggregate. Ordered by order_by (ties by the value, so that the order is total),
    distinct in byte order, or as they come. Of rows without keep nothing is taken."""
    value = F.col(spec.select)
    only = lambda x: x if keep is None else F.when(keep, x)
    if spec.distinct:
        return F.array_sort(F.collect_set(only(value)))
    if spec.order_by:
        return F.transform(F.array_sort(F.collect_list(only(F.struct(F.col(spec.order_by).alias("o"), value.alias("x"))))), lambda s: s.x)
    return F.collect_list(only(value))


def child_collection(child: DataFrame, spec: Child) -> DataFrame:
    """The parent's join columns and `items`, an array of the non-null values of each parent's rows."""
    return child.where(_wanted(spec)).groupBy(*(F.col(c).alias(p) for c, p in spec.join.items())).agg(_items(spec).alias("items"))


def source_rows(rule: DocType, parent: DataFrame, children: dict[str, DataFrame], few: bool = False) -> DataFrame:
    """record_key, the parent columns that the rule reads, and an array for each child. Only referenced columns are scanned.

    Children of one table with one join come from one aggregate. few: the parent is a part of its table, so only child
    rows that join it are collected.
    """
    names = rule.columns()
    out = parent.select(F.col(rule.source.key).cast("string").alias("record_key"), *names)
    groups: dict[tuple, list[str]] = {}
    for alias, spec in rule.children.items():
        need = [c for c in spec.join.values() if c not in names]
        if need:
            raise KeyError(f"child {alias} joins on {need}, which the parent's rows lack")
        groups.setdefault((spec.namespace, spec.table, tuple(spec.join.items())), []).append(alias)
    for k, ((_, _, join), aliases) in enumerate(groups.items()):
        rows = children[aliases[0]]
        if few:
            own = parent.select(*(F.col(p).alias(f"__{k}_{p}") for _, p in join)).distinct()
            rows = rows.join(own, [rows[c] == own[f"__{k}_{p}"] for c, p in join], "left_semi")
        wanted = {a: _wanted(rule.children[a]) for a in aliases}
        some = reduce(lambda x, y: x | y, wanted.values())
        empty = lambda x: F.when(F.size(x) > 0, x)
        items = rows.where(some).groupBy(*(F.col(c).alias(f"__{k}_{p}") for c, p in join)).agg(*(empty(_items(rule.children[a], wanted[a] if len(aliases) > 1 else None)).alias(a) for a in aliases))
        out = out.join(items, [out[p] == items[f"__{k}_{p}"] for _, p in join], "left").drop(*(f"__{k}_{p}" for _, p in join))
    return out


def _scalar_format(c: Column, kind: T.DataType, how: str | None) -> Column:
    if how == "iso":
        return F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("string")
    if how == "year":
        return F.year(c) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast("int")
    if how == "thousands":
        n = c.try_cast("bigint") if isinstance(kind, (T.NumericType, T.StringType)) else F.lit(None).cast("bigint")
        return F.when(n != 0, F.format_number(n, 0))
    return c


class Compiler:
    """Value specs over the columns of a schema. text() is never null; raw() is null when there is nothing."""

    def __init__(self, schema: T.StructType):
        self.kinds = {f.name: f.dataType for f in schema.fields}

    def formatted(self, name: str, how: str | None) -> Column:
        kind = self.kinds[name]
        if isinstance(kind, T.ArrayType):
            return F.transform(F.col(name), lambda x: _scalar_format(x, kind.elementType, how))
        return _scalar_format(F.col(name), kind, how)

    def _column_text(self, name: str, spec: Value) -> Column:
        c = self.formatted(name, spec.format)
        if isinstance(self.kinds[name], T.ArrayType):
            shown = F.transform(c, lambda x: x.cast("string"))
            c = F.array_join(F.filter(shown, lambda x: x.isNotNull() & (strip(x) != "")), spec.separator)
        elif isinstance(self.kinds[name], T.BooleanType):
            c = F.initcap(c.cast("string"))
        return F.coalesce(blank_to_null(c.cast("string")), F.lit(""))

    def text(self, spec: Value) -> Column:
        if spec.const is not None:
            return F.lit(spec.const)
        if spec.coalesce is not None:
            return F.coalesce(*(F.nullif(self.text(x), F.lit("")) for x in spec.coalesce), F.lit(""))
        if spec.join is not None:
            return F.concat_ws(spec.separator, *(F.nullif(self._column_text(n, spec), F.lit("")) for n in spec.join))
        if spec.template is not None:
            pieces = re.split(r"\{(\w+)\}", spec.template)
            parts = [F.nullif(self._column_text(p, spec), F.lit("")) if i % 2 else F.lit(p.replace("{{", "{").replace("}}", "}")) for i, p in enumerate(pieces)]
            return F.coalesce(F.concat(*parts), F.lit(""))
        return self._column_text(spec.field, spec)

    def raw(self, spec: Value) -> Column:
        """An int stays an int and a list a list, without its nulls; empty text and empty lists are null."""
        if spec.field is not None:
            c = self.formatted(spec.field, spec.format)
            kind = self.kinds[spec.field]
            if isinstance(kind, T.ArrayType):
                kept = F.filter(c, lambda x: x.isNotNull())
                return F.when(F.size(kept) > 0, kept)
            if isinstance(kind, T.StringType):
                return F.nullif(c, F.lit(""))
            return F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) and spec.format is None else c
        if spec.coalesce is not None and all(x.field is not None or x.const is not None for x in spec.coalesce):
            out = F.lit(None)
            for x in reversed(spec.coalesce):
                out = F.when(self.text(x) != "", self.raw(x)).otherwise(out)
            return out
        return F.nullif(self.text(spec), F.lit(""))


def canonical_json(values: dict[str, Column]) -> Column:
    """A JSON object of the non-null values, keys in order; equal objects are equal texts."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values)))) if values else F.lit("{}")


def content_hash(title: Column, body: Column) -> Column:
    return sha256(F.concat(title, F.lit("\n"), body))


def tracked_hash(columns: dict[str, Column], track: tuple[str, ...]) -> Column:
    """What opens a new version when it differs: the content hash for title and body, else of all tracked attributes."""
    if set(track) == {"title", "body"}:
        return content_hash(columns["title"], columns["body"])
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(columns[name].cast("string"), F.lit(""))) for name in sorted(track)]
    return sha256(F.concat_ws("\x1e", *parts))


def build_documents(rule: DocType, rows: DataFrame) -> DataFrame:
    """record_key, doc_id, doc_type, source_id, title, body, url, metadata, is_active, content_hash, tracked_hash."""
    make = Compiler(rows.schema)
    lines = []
    for label, value in rule.body:
        text = make.text(value)
        lines.append(F.when(text != "", F.concat(F.lit(f"{label}: "), text)))
    url = F.nullif(make.text(rule.url), F.lit("")) if rule.url else F.lit(None).cast("string")
    docs = rows.select(
        "record_key", F.concat(F.lit(f"{rule.doc_type}:"), F.col("record_key")).alias("doc_id"), F.lit(rule.doc_type).alias("doc_type"), F.lit(rule.source.source_id).alias("source_id"),
        make.text(rule.title).alias("title"), F.concat_ws("\n", *lines).alias("body"), url.alias("url"), canonical_json({k: make.raw(v) for k, v in rule.metadata.items()}).alias("metadata"),
        F.coalesce(F.col(rule.source.active_column), F.lit(False)).alias("is_active"),
    )
    attributes = {c: F.col(c) for c in ("title", "body", "url", "metadata")}
    return docs.withColumn("content_hash", content_hash(F.col("title"), F.col("body"))).withColumn("tracked_hash", tracked_hash(attributes, rule.scd2.track))


def document_text(title: Column, body: Column) -> Column:
    """What is chunked."""
    return F.concat(title, F.lit("\n\n"), body)
