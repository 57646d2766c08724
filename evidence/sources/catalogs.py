"""Catalog runs in the store, and the catalog as YAML.

A run's tables, columns and relationships are added first and the run itself last, so a save that fails part way leaves
no run behind. Runs are kept: which structure the sources had, and when, can be read later. Only the latest is loaded.
"""

from __future__ import annotations

import datetime
import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence.operators.catalog import Catalog, Table
from evidence.sources.store import Store

RUNS = "run string, captured_at timestamp, source string, digest string, tables int, columns int, relationships int"
TABLES = "run string, name string, key array<string>, unique array<array<string>>, rows long"
COLUMNS = "run string, table_name string, position int, name string, type string"
RELATIONSHIPS = "run string, parent string, child string, columns array<string>"
_log = logging.getLogger(__name__)


def save_catalog(store: Store, catalog: Catalog, source: str = "cli", now: datetime.datetime | None = None) -> str:
    """Add a run; its name."""
    run, at = uuid.uuid4().hex, now or datetime.datetime.now(datetime.UTC)
    tables = [(run, t.name, list(t.key), [list(u) for u in t.unique], t.rows) for t in catalog.tables.values()]
    cells = [(run, t.name, i, c, kind) for t in catalog.tables.values() for i, (c, kind) in enumerate(t.columns.items())]
    links = [(run, p, c, list(k)) for p, c, k in catalog.relationships]
    whole = [(run, at, source, catalog.digest(), len(tables), len(cells), len(links))]
    for name, rows, schema in (("catalog_table", tables, TABLES), ("catalog_column", cells, COLUMNS), ("catalog_relationship", links, RELATIONSHIPS), ("catalog_run", whole, RUNS)):
        if rows:
            store.append(name, store.spark.createDataFrame(rows, schema).coalesce(1))
    _log.info("catalog saved", extra={"run": run, "digest": catalog.digest()[:12], "tables": len(tables)})
    return run


def catalog_runs(store: Store) -> DataFrame:
    """The latest first."""
    return store.log("catalog_run", RUNS).orderBy(F.desc("captured_at"), F.desc("run"))


def load_catalog(store: Store) -> Catalog | None:
    """The catalog of the latest run; None if there is none."""
    last = catalog_runs(store).first()
    if last is None:
        return None
    own = lambda name, schema: store.log(name, schema).where(F.col("run") == last["run"])
    columns: dict[str, dict[str, str]] = {}
    for r in own("catalog_column", COLUMNS).orderBy("table_name", "position").collect():
        columns.setdefault(r["table_name"], {})[r["name"]] = r["type"]
    tables = {
        r["name"]: Table(r["name"], columns.get(r["name"], {}), tuple(r["key"]), tuple(map(tuple, r["unique"])), r["rows"])
        for r in own("catalog_table", TABLES).orderBy("name").collect()
    }
    links = own("catalog_relationship", RELATIONSHIPS).orderBy("parent", "child").collect()
    return Catalog(tables, [(r["parent"], r["child"], tuple(r["columns"])) for r in links])


def to_yaml(catalog: Catalog) -> str:
    import yaml  # optional; only the export and rule files need it

    return yaml.safe_dump({"digest": catalog.digest(), **catalog.to_dict()}, sort_keys=False, allow_unicode=True)
