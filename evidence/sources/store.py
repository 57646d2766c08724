"""Versioned tables under one manifest: data and watermark are published together or not at all.

A keyed table is a list of layers. A batch adds one: the rows that it makes, and marks, the keys whose rows of earlier
batches are dead. So what a batch writes follows what it changes, not how large the table is; rows and marks are merged when
they are read. Layers that are no larger than what came after them are folded into one, so their number grows with the
logarithm of the batches, and a row is rewritten as often; marks go when they reach the oldest layer. Within a layer rows
lie in buckets by the hash of one column, in order of the key, so that a read of a few keys opens a few buckets and skips
what their statistics rule out.

The manifest names the layers or folders of every table, the watermarks and the index state. It goes through Hadoop's file
system: written beside, then renamed to a new number, which fails if that number exists. A crash before the rename leaves
nothing visible, and of two writers that start from the same manifest one fails. sweep() removes the folders that no kept
manifest names.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the manifest's layout; a store of another one is refused until it is migrated.
SCHEMA = 3
BUCKETS = 64
#: Marks are broadcast to the rows that they may kill only if there are no more than this; they hold a key each.
BROADCAST_MARKS = 1_000_000
#: Tables that a batch writes for itself alone.
SCRATCH = ("changed", "extract", "decision", "made", "todo")


@dataclass(frozen=True)
class Keyed:
    """key: what tells a row from others. by: the column whose hash gives the bucket, or that is its number (plain)."""

    key: tuple[str, ...]
    by: str
    plain: bool = False

    def bucket(self, buckets: int) -> Column:
        return F.col(self.by).cast("int") if self.plain else bucket_of(F.col(self.by), buckets)


KEYED = {"document": Keyed(("doc_sk",), "doc_id"), "chunk": Keyed(("chunk_id",), "doc_id"), "posting": Keyed(("lexeme", "chunk_id"), "lexeme"), "vector_list": Keyed(("chunk_id",), "list", plain=True), "meta": Keyed(("pair", "doc_sk"), "pair")}


class Conflict(RuntimeError):
    """Another batch was published first."""


class Leased(RuntimeError):
    """Another writer holds the store, and held it as long as this one would wait."""


class OldSchema(RuntimeError):
    """The store was written with another layout."""


@dataclass
class Manifest:
    number: int = 0
    #: A keyed table has a list of layers (path, rows, marks), the oldest first, whose path has * for rows or marks; others
    #: have folders, by name or one.
    tables: dict[str, str | dict[str, str] | list[dict]] = field(default_factory=dict)
    watermarks: dict[str, dict] = field(default_factory=dict)
    index: dict = field(default_factory=dict)
    runs: dict[str, dict] = field(default_factory=dict)
    #: How many buckets tables have, fixed by a store's first batch, and the largest surrogate key given (None: not known).
    buckets: int = BUCKETS
    top: int | None = None
    #: How many chunks there are (None: not known).
    chunks: int | None = None
    schema: int = SCHEMA


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """buckets: of a store that has none yet; what a read of few keys opens is a bucket, so large tables want many."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _numbers(self) -> list[int]:
        where = self._path("_manifests")
        if not self._fs.exists(where):
            return []
        return sorted(int(n) for s in self._fs.listStatus(where) if (n := s.getPath().getName().removesuffix(".json")).isdigit())

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"_manifests/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        numbers = self._numbers()
        if not numbers:
            return Manifest(buckets=self.buckets)
        found = self._read(numbers[-1])
        if found.get("schema", 1) != SCHEMA:
            raise OldSchema(f"{self.root} has layout {found.get('schema', 1)}, this is {SCHEMA}: migrate it first")
        return Manifest(**found)

    def migrate(self) -> int:
        """Bring the store to this layout; how many steps that took. Layouts 1 and 2 kept a table in one folder or a folder a
        bucket; such a table is read as it is, and becomes the oldest layer when a batch first adds to it."""
        numbers = self._numbers()
        found = self._read(numbers[-1]) if numbers else {"schema": SCHEMA}
        steps = SCHEMA - found.get("schema", 1)
        if steps < 0:
            raise OldSchema(f"{self.root} has layout {found['schema']}, newer than {SCHEMA}")
        if steps:
            self.publish(Manifest(**{**found, "schema": SCHEMA}))
        return steps

    def folders(self, name: str, manifest: Manifest) -> dict[str, str]:
        """Of a table that isn't in layers."""
        held = manifest.tables.get(name)
        return held if isinstance(held, dict) else {"": held} if held else {}

    def table(self, name: str, schema: str, manifest: Manifest | None = None, buckets: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """A table as the manifest has it, or some buckets of one in layers; empty if it has none. The schema is given, never inferred.

        where: a condition on key columns; it reaches rows and marks before they meet.
        """
        manifest = manifest or self.manifest()
        held = manifest.tables.get(name)
        if isinstance(held, list):
            return self._alive(name, schema, held, buckets, where).select(*columns(schema))
        paths = [f"{self.root}/{p}" for p in self.folders(name, manifest).values()]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if buckets is not None and name in KEYED:
            found = found.where(KEYED[name].bucket(manifest.buckets).isin(buckets))
        return found if where is None else found.where(where)

    def _part(self, part: str, schema: str, layers: list[dict], buckets: list[int] | None, where: Column | None) -> DataFrame:
        """Rows or marks of layers, with _batch and b."""
        schema = f"{schema}, _batch long, v string, b int"
        paths = [f"{self.root}/{layer['path'].replace('*', part)}" for layer in layers if layer[part]]
        if paths:
            found = self.spark.read.option("basePath", paths[0].rpartition("/")[0]).schema(schema).parquet(*paths).drop("v")
        else:
            found = self.spark.createDataFrame([], schema).drop("v")
        found = found if buckets is None else found.where(F.col("b").isin(buckets))
        return found if where is None else found.where(where)

    def _alive(self, name: str, schema: str, layers: list[dict], buckets: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """Rows that no mark of a later batch kills, with _batch and b."""
        key = list(KEYED[name].key)
        rows, n = self._part("rows", schema, layers, buckets, where), sum(layer["marks"] for layer in layers)
        if not n:
            return rows
        kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}
        marks = self._part("marks", ", ".join(f"{k} {kinds[k]}" for k in key), layers, buckets, where)
        last = marks.groupBy(*key).agg(F.max("_batch").alias("_until"))
        joined = rows.join(F.broadcast(last) if n <= BROADCAST_MARKS else last, key, "left")
        return joined.where("_until is null or _batch >= _until").drop("_until")

    def write(self, name: str, df: DataFrame, batch: int) -> str:
        path = f"{name}/v={batch}"
        df.write.mode("overwrite").parquet(f"{self.root}/{path}")
        return path

    def add_layer(self, name: str, schema: str, rows: DataFrame, marks: DataFrame | None, batch: int, manifest: Manifest) -> list[dict]:
        """What a keyed table becomes when a batch adds rows and kills those of marks (key columns and the bucket's column)."""
        kind, held = KEYED[name], manifest.tables.get(name)
        if held and not isinstance(held, list):  # an older layout
            held = [self._write_layer(name, f"{name}/*/v={batch}-first", self.table(name, schema, manifest).withColumn("_batch", F.lit(0).cast("long")), None, manifest)]
        own = rows.select(*columns(schema)).withColumn("_batch", F.lit(batch).cast("long"))
        dead = marks.select(*dict.fromkeys((*kind.key, kind.by))).withColumn("_batch", F.lit(batch).cast("long")) if marks is not None and held else None
        layer = self._write_layer(name, f"{name}/*/v={batch}", own, dead, manifest)
        return self._folded(name, schema, [*(held or []), *([layer] if layer["rows"] or layer["marks"] else [])], batch, manifest)

    def _write_layer(self, name: str, path: str, rows: DataFrame, marks: DataFrame | None, manifest: Manifest) -> dict:
        kind, counts = KEYED[name], {"rows": 0, "marks": 0}
        for part, df in (("rows", rows), ("marks", marks)):
            if df is None:
                continue
            # Rebalanced, not repartitioned: small buckets share a task, a large one is written by several.
            dealt = df.withColumn("b", kind.bucket(manifest.buckets)).hint("rebalance", "b").sortWithinPartitions("b", *kind.key)
            counts[part] = self._write_part(path, part, dealt.drop(*({kind.by} - set(kind.key) if part == "marks" else ())))
        return {"path": path, **counts}

    def _write_part(self, path: str, part: str, df: DataFrame) -> int:
        """Write rows or marks in folders by bucket; how many they are, which the files' footers tell."""
        where = f"{self.root}/{path.replace('*', part)}"
        df.write.mode("overwrite").partitionBy("b").parquet(where)
        return self.spark.read.schema("_batch long").parquet(where).count()

    def _folded(self, name: str, schema: str, layers: list[dict], batch: int, manifest: Manifest) -> list[dict]:
        """Fold the latest layers into one while the layer before them is no larger than they are together."""
        size = lambda layer: layer["rows"] + layer["marks"]
        first, total = len(layers) - 1, size(layers[-1]) if layers else 0
        while first > 0 and size(layers[first - 1]) <= total:
            first -= 1
            total += size(layers[first])
        if len(layers) - first < 2:
            return layers
        tail, kind = layers[first:], KEYED[name]
        marks = None
        if first and any(layer["marks"] for layer in tail):
            kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema)}
            marks = self._part("marks", ", ".join(f"{k} {kinds[k]}" for k in kind.key), tail, None, None).groupBy(*kind.key).agg(F.max("_batch").alias("_batch"), F.first("b").alias("b"))
        path = f"{name}/*/v={batch}-folded"
        counts = {"rows": 0, "marks": 0}
        for part, df in (("rows", self._alive(name, schema, tail)), ("marks", marks)):
            if df is not None:
                counts[part] = self._write_part(path, part, df.hint("rebalance", "b").sortWithinPartitions("b", *kind.key))
        folded = {"path": path, **counts}
        return [*layers[:first], *([folded] if folded["rows"] or folded["marks"] else [])]

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table that only grows (a log): a folder of files beside the manifest's tables."""
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def log(self, name: str, schema: str) -> DataFrame:
        """What append() has written."""
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def publish(self, manifest: Manifest) -> Manifest:
        """Publish the successor of the manifest that manifest was made from (its number)."""
        after = Manifest(**{**asdict(manifest), "number": manifest.number + 1})
        self._fs.mkdirs(self._path("_manifests"))
        target, draft = self._path(f"_manifests/{after.number:012d}.json"), self._path(f"_manifests/.draft-{self._jvm.java.util.UUID.randomUUID()}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(asdict(after), sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"manifest {after.number} exists")
        return after

    @contextlib.contextmanager
    def lease(self, seconds: float = 3600, wait: float = 600, pause: float = 1) -> Iterator[None]:
        """Hold the store for writing, so that no other writer works from a manifest that is about to be old.

        A lease is a file that is created only where there is none. One that outlives its time is its holder's no more and is
        taken away. wait: how long to try before Leased. Two writers that take away the same lease at once may both go on;
        then publish() lets one of them through, as it does without leases.
        """
        path, own = self._path("_lease"), uuid.uuid4().hex
        until = time.time() + wait
        while not self._take(path, own, time.time() + seconds):
            if time.time() >= until:
                raise Leased(f"another writer holds {self.root}")
            time.sleep(pause)
        try:
            yield
        finally:
            if (self._text(path) or {}).get("own") == own:
                self._fs.delete(path, False)

    def _text(self, path) -> dict | None:
        try:
            stream = self._fs.open(path)
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):  # gone, or not written out yet
            return None

    def _take(self, path, own: str, until: float) -> bool:
        held = self._text(path)
        if held is not None and held["until"] < time.time():
            self._fs.delete(path, False)
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError:
            return False
        out.write(bytearray(json.dumps({"own": own, "until": until}).encode()))
        out.close()
        return True

    def exists(self, path: str) -> bool:
        """Whether there is a file or folder of that whole path, in whatever file system it names."""
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def remove(self, name: str) -> None:
        """Remove what append() has written."""
        self._fs.delete(self._path(name), True)

    def sweep(self, keep: int = 2) -> int:
        """Remove manifests but the last few, and the folders that none of those names, of tables and of published batches'
        scratch tables; how many folders went."""
        numbers = self._numbers()
        if not numbers:
            return 0
        kept = [self._read(n) for n in numbers[-keep:]]
        parts = ("rows", "marks")
        paths = lambda held: [x["path"].replace("*", p) for x in held for p in parts] if isinstance(held, list) else list(held.values()) if isinstance(held, dict) else [held]
        named = {p for m in kept for held in m["tables"].values() for p in paths(held)}
        gone = 0
        for name in SCRATCH:
            for version in self._fs.listStatus(self._path(name)) if self._fs.exists(self._path(name)) else ():
                if int(version.getPath().getName().removeprefix("v=").partition("-")[0]) <= numbers[-1]:
                    self._fs.delete(version.getPath(), True)
                    gone += 1
        tables = {t for m in kept for t in m["tables"]}
        for name in [*tables, *(f"{t}/{p}" for t in tables for p in parts)]:
            if not self._fs.exists(self._path(name)):
                continue
            for version in self._fs.listStatus(self._path(name)):
                path = f"{name}/{version.getPath().getName()}"
                if version.getPath().getName() in parts:
                    continue
                inner = [f"{path}/{s.getPath().getName()}" for s in self._fs.listStatus(version.getPath()) if s.getPath().getName().startswith("b=")]
                # Of a table in layers a version goes whole; of an older layout, bucket by bucket.
                whole = path in named or not any(p in named for p in inner)
                dead = ([] if path in named else [path]) if whole else [p for p in inner if p not in named]
                for p in dead:
                    self._fs.delete(self._path(p), True)
                gone += len(dead)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"_manifests/{n:012d}.json"), False)
        return gone


def columns(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).names
