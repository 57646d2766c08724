"""The metadata catalog: tables and columns from schemas, declared keys, inferred relationships, a digest; rule validation."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence.rules.spec import DocType


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: None: not counted.
    rows: int | None = None

    def is_unique(self, columns: tuple[str, ...]) -> bool:
        """Whether exactly these columns, in this order, are declared a key."""
        return bool(columns) and (columns == self.key or columns in self.unique)


@dataclass
class Catalog:
    tables: dict[str, Table]
    relationships: list[tuple[str, str, tuple[str, ...]]] = field(default_factory=list)

    def digest(self) -> str:
        """Of structure only: the order of tables and when they were read don't matter."""
        shape = {n: [dict(sorted(t.columns.items())), t.key, sorted(t.unique)] for n, t in sorted(self.tables.items())}
        return hashlib.sha256(json.dumps([shape, sorted(self.relationships)], sort_keys=True).encode()).hexdigest()

    def to_dict(self) -> dict:
        size = lambda t: {} if t.rows is None else {"rows": t.rows}
        tables = {n: {"columns": t.columns, "key": list(t.key), "unique": [list(u) for u in t.unique], **size(t)} for n, t in sorted(self.tables.items())}
        return {"tables": tables, "relationships": [{"parent": p, "child": c, "columns": list(k)} for p, c, k in sorted(self.relationships)]}


def read_catalog(frames: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], exclude: tuple[str, ...] = (), unique: dict[str, tuple[tuple[str, ...], ...]] | None = None, sizes: bool = False) -> Catalog:
    """From the schemas of tables and their declared keys, without the tables whose name matches exclude.

    unique: further declared keys. sizes: count rows, which Parquet tables tell from their footers.
    """
    tables, more = {}, unique or {}
    for name, df in frames.items():
        if not any(fnmatch.fnmatch(name, p) for p in exclude):
            shape = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            tables[name] = Table(name, shape, tuple(keys.get(name, ())), tuple(map(tuple, more.get(name, ()))), df.count() if sizes else None)
    found = Catalog(tables)
    found.relationships = [(p, c, tables[p].key) for p in tables for c in tables if _extends(tables[p].key, tables[c].key)]
    return found


def _extends(parent: tuple[str, ...], child: tuple[str, ...]) -> bool:
    return 0 < len(parent) < len(child) and child[: len(parent)] == parent


def infer_relationships(keys: DataFrame) -> DataFrame:
    """keys: table_name, key (array). parent, child, columns where the child's key starts with the parent's and is longer.

    An equi-join on the parent's key text: each child offers the proper prefixes of its key.
    """
    offered = keys.select(F.col("table_name").alias("child"), F.explode(F.transform(F.sequence(F.lit(1), F.size("key")), lambda n: F.slice("key", 1, n))).alias("columns"), F.size("key").alias("n")).where(F.size("columns") < F.col("n"))
    parents = keys.where(F.size("key") > 0).select(F.col("table_name").alias("parent"), F.col("key").alias("columns"))
    return parents.join(offered, "columns").select("parent", "child", F.array_join("columns", ",").alias("columns"))


#: Error of the distinct counts, for one standard deviation; a column is left open within three of them.
SKETCH_ERROR = 0.02
#: Of a child's values so many times the sketch's error may be missing among a parent's before an exact check is in vain.
_LG_K = 14


def sketches(df: DataFrame) -> DataFrame:
    """One row for each column of a simple type: column, kind, n, nulls, approx (distinct values), sketch (of those). One pass."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    text = lambda f: F.col(f"`{f.name}`").cast("string")
    told = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count("*").alias("n"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), F.approx_count_distinct(f"`{f.name}`", SKETCH_ERROR).alias("approx"), F.theta_sketch_agg(text(f), _LG_K).alias("sketch")) for f in fields]
    return df.agg(F.array(*told).alias("c")).select(F.inline("c"))


def find_keys(df: DataFrame, told: DataFrame | None = None) -> list[str]:
    """Columns without nulls whose values are all different. Sketches rule out nearly all that aren't; what they leave open is counted."""
    rows = (sketches(df) if told is None else told).select("column", "n", "nulls", "approx").collect()
    open_ = [r["column"] for r in rows if r["n"] and not r["nulls"] and r["approx"] >= (1 - 3 * SKETCH_ERROR) * r["n"]]
    return [c for c in open_ if verify_key(df, (c,))]


def verify_reference(child: DataFrame, column: str, parent: DataFrame, key: str) -> bool:
    """Whether every value of a child's column is a key of the parent; null refers to nothing."""
    own = child.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct()
    return not own.join(parent.select(F.col(f"`{key}`").alias("v")), "v", "left_anti").take(1)


def find_references(frames: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, key) where all values of a child's column are values of a parent's one-column key.

    A pass over each table sketches its columns; pairs of a kind whose sketches differ by more than their error are no
    references, and only the others are joined. Columns without values refer to nothing.
    """
    told = {n: sketches(df).collect() for n, df in frames.items()}
    spark = next(iter(frames.values())).sparkSession
    schema = "column string, kind string, n long, nulls long, approx long, sketch binary"
    keys = {n: find_keys(df, spark.createDataFrame(told[n], schema)) for n, df in frames.items()}
    held = spark.createDataFrame([(n, r["column"], r["kind"], r["n"] - r["nulls"], r["sketch"], r["column"] in keys[n]) for n in frames for r in told[n]], "t string, c string, kind string, n long, sketch binary, is_key boolean")
    child, parent = held.where("n > 0").alias("a"), held.where("is_key").alias("b")
    # A row for each column of the catalog: few by nature.
    pairs = child.join(F.broadcast(parent), F.col("a.kind").eqNullSafe(F.col("b.kind")) & ((F.col("a.t") != F.col("b.t")) | (F.col("a.c") != F.col("b.c"))))
    missing = F.theta_sketch_estimate(F.theta_difference("a.sketch", "b.sketch"))
    near = pairs.where(missing <= 5 * F.theta_sketch_estimate("b.sketch") / 2 ** (_LG_K / 2) + 1).select("a.t", "a.c", F.col("b.t").alias("pt"), F.col("b.c").alias("pc")).collect()
    return sorted((t, c, pt, pc) for t, c, pt, pc in near if verify_reference(frames[t], c, frames[pt], pc))


def verify_key(df: DataFrame, key: tuple[str, ...]) -> bool:
    """Whether a declared key holds: no null in it and no value twice."""
    return not df.groupBy(*key).count().where("count > 1").take(1) and not df.where(" or ".join(f"`{k}` is null" for k in key)).take(1)


def validate(rule: DocType, frames: dict[str, DataFrame], catalog: Catalog) -> list[tuple[str, str]]:
    """(severity, message) for what doesn't fit the tables: before any row is read."""
    out: list[tuple[str, str]] = []
    name = lambda x: f"{x.namespace}.{x.table}" if x.namespace else x.table
    parent = frames.get(name(rule.source))
    if parent is None:
        return [("error", f"there is no table {name(rule.source)}")]
    kinds = {f.name: f.dataType for f in parent.schema.fields}
    out += [("error", f"{name(rule.source)} has no column {c}") for c in rule.columns() if c not in kinds]
    table = catalog.tables.get(name(rule.source))
    if table is None or not table.is_unique((rule.source.key,)):
        out.append(("error", f"{rule.source.key} is no key of {name(rule.source)}"))
    if rule.source.active_column in kinds and not isinstance(kinds[rule.source.active_column], T.BooleanType):
        out.append(("error", f"{rule.source.active_column} is not boolean"))
    for alias, child in rule.children.items():
        if alias in kinds:
            out.append(("error", f"child {alias} is also a column"))
        df = frames.get(name(child))
        if df is None:
            out.append(("error", f"there is no table {name(child)}"))
            continue
        used = {*child.join, child.select, *([child.order_by] if child.order_by else []), *(x[0] for x in (child.eq, child.ne) if x)}
        out += [("error", f"{name(child)} has no column {c}") for c in sorted(used - set(df.columns))]
        out += [("error", f"{name(rule.source)} has no column {c}") for c in child.join.values() if c not in kinds]
        if not any(p == name(rule.source) and c == name(child) for p, c, _ in catalog.relationships):
            out.append(("warning", f"no key backs the join of {alias}"))
    return out
