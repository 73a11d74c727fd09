"""Stored tables with versions and atomic commits (K1, K2, K3).

A table is a folder::

    data/increment=<name>/<partition>=<value>/part-*.parquet    written once, never changed
    versions/<number>.json                                      what belongs to a version

A version names, for each value of the partition column, the increments that hold its rows. A
write puts its rows into a new increment first; then one rename moves the new
version file into place. Until then readers see the version before, and a job
that ends in between leaves it as it was (its increment belongs to nothing and
goes with ``vacuum``). A folder of plain partitioned Parquet is taken over as version 0. A reader keeps the version it opened. Two writers that
start from one version cannot both commit: the later one finds the file
there and does its work again on the new version.

An upsert writes the new rows once and rewrites only the partitions that hold
a row it replaces; the others are taken over by name. A version file has one
entry per partition and increment, none per row or file.

A version also keeps the last batch number of each stream that wrote to the
table, in the same commit as the batch's rows: a replayed batch is seen and
left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.schema import LOG_SCHEMA

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Stands for the partitions of a plain Parquet folder that became a table: they lie beside ``data``.
PLAIN = ""
#: Rows of stored vectors (K2); ``event_date`` is the day of ``timestamp``, ``event_month`` the first day of its month.
#: Search never asks for a day, so a month makes one partition: a long time with few vectors a day is not one file a day.
VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("document", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("hostname", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("log_type", T.StringType()),
    T.StructField("event_date", T.DateType()), T.StructField("event_month", T.DateType())])
MOST_TRIES = 10


class CommitConflict(RuntimeError):
    """Another writer made this version first."""


@dataclass
class Version:
    number: int = 0
    #: Partition value as in its folder's name -> increments.
    parts: dict[str, list[str]] = field(default_factory=dict)
    #: Stream name -> last batch number.
    batches: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A stored table of ``schema``, partitioned by ``partition``, with rows identified by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA, partition: str = "event_date",
                 key: str = "id", order: str = "ingested_at"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.partition, self.key, self.order = partition, key, order

    # -- files ----------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def numbers(self) -> list[int]:
        """Numbers of the versions that are kept, oldest first."""
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version's contents (default: the newest; an unwritten table is the empty version 0)."""
        kept = self.numbers()
        if number is None:
            number = kept[-1] if kept else 0
        if number == 0:
            return Version(parts={v: [PLAIN] for v in self._values_in(self.path)})
        if number not in kept:
            raise ValueError(f"version {number} of {self.path} is not kept")
        fs, at = self._fs(f"{self.path}/versions/{number:020d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def commit(self, version: Version) -> None:
        """Make ``version`` the newest; raises CommitConflict where its number is taken."""
        jvm = self.spark._jvm
        folder = f"{self.path}/versions"
        fs, at = self._fs(f"{folder}/.{uuid.uuid4().hex}.tmp")
        fs.mkdirs(at.getParent())
        out = fs.create(at, False)
        try:
            out.write(bytearray(json.dumps({"parts": version.parts, "batches": version.batches}).encode()))
        finally:
            out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{version.number:020d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE  # never over an existing file
        try:
            files.rename(fs.makeQualified(at), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(at, False)
            if fs.exists(target):
                raise CommitConflict(f"version {version.number} of {self.path}") from e
            raise

    def exists(self) -> bool:
        fs, at = self._fs(self.path)
        return fs.exists(at)

    def _values_in(self, folder: str) -> list[str]:
        head = f"{self.partition}="
        return sorted(n[len(head):] for n in self._names(folder) if n.startswith(head))

    # -- rows -------------------------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """Rows of a version (default: the newest; 0 is the table as it was before its first version)."""
        return self._rows(self.version(number))

    def _rows(self, version: Version, only: set[str] | None = None) -> DataFrame:
        chosen = [(v, i) for v, increments in version.parts.items() if only is None or v in only for i in increments]
        by_increment: dict[str, list[str]] = {}
        for v, i in chosen:
            if i != PLAIN:
                by_increment.setdefault(i, []).append(v)
        folders = []
        for i, values in by_increment.items():
            folder = f"{self.path}/data/increment={i}"
            # An increment that belongs whole is one path: Spark lists its days in parallel.
            whole = len(values) > 1 and set(values) == set(self._values_in(folder))
            folders += [folder] if whole else [f"{folder}/{self.partition}={v}" for v in values]
        plain = [f"{self.path}/{self.partition}={v}" for v, i in chosen if i == PLAIN]
        read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("increment", T.StringType())]))
        out = None
        if folders:
            out = read.option("basePath", f"{self.path}/data").parquet(*folders).select(*self.schema.names)
        if plain:
            old = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*plain)
            old = old.select(*self.schema.names)
            out = old if out is None else out.union(old)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def _increment(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as a new increment; its name and the partition values in it."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/increment={name}"
        # Ranges of (partition, key): a hot day is split over several tasks, other days lie in one or two each, so there
        # are about as many files as days and tasks, not days times tasks, and no task sorts a whole input split.
        # Tasks keep one file open at a time.
        (rows.select(*self.schema.names).repartitionByRange(self.partition, self.key).sortWithinPartitions(self.partition)
         .write.partitionBy(self.partition).parquet(folder))
        return name, self._values_in(folder)

    def _values(self, rows: DataFrame) -> set[str]:
        """Partition values of rows as in folder names (one per stored partition at most)."""
        found = rows.select(F.col(self.partition).cast("string").alias("v")).distinct().collect()
        return {NULL_PARTITION if r.v is None else r.v for r in found}

    def _change(self, make: Callable[[Version], Version | None]) -> Version:
        """Commit what ``make`` makes of the newest version (None: nothing to do); again where another writer was faster."""
        for _ in range(MOST_TRIES):
            base = self.version()
            made = make(base)
            if made is None:
                return base
            made.number = base.number + 1
            try:
                self.commit(made)
                return made
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.path}: {MOST_TRIES} versions were made by others")

    def write(self, rows: DataFrame, replace: bool = True) -> Version:
        """Add rows; with ``replace`` they stand for all rows of the partitions they lie on."""
        written: list = []

        def make(base: Version) -> Version:
            if not written:
                written.append(self._increment(rows))
            name, values = written[0]
            return Version(parts=base.parts | {v: [name] if replace else [*base.parts.get(v, []), name] for v in values},
                           batches=base.batches)
        return self._change(make)

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> Version:
        """Insert or replace by key; of several new rows with one key the newest by ``order`` stays.

        With ``stream`` and ``batch`` a batch that is in the table already changes nothing.
        """
        from sieveline.sources.sinks import latest_per_id
        written: list = []

        def make(base: Version) -> Version | None:
            if stream is not None and base.batches.get(stream, -1) >= batch:
                return None
            if not written:
                written.append(self._increment(latest_per_id(new.select(*self.schema.names), self.order)))
            name, values = written[0]
            if not values and stream is None:
                return None
            parts = {v: list(x) for v, x in base.parts.items()}
            if parts and values:
                fresh = self._rows(Version(parts={v: [name] for v in values})).select(self.key)
                stored = self._rows(base)
                touched = self._values(stored.join(fresh, self.key, "left_semi"))
                if touched:
                    rest, left = self._increment(self._rows(base, touched).join(fresh, self.key, "left_anti"))
                    parts = {v: x for v, x in parts.items() if v not in touched} | {v: [rest] for v in left}
            for v in values:
                parts[v] = [*parts.get(v, []), name]
            batches = base.batches | ({stream: batch} if stream is not None else {})
            return Version(parts=parts, batches=batches)

        return self._change(make)

    def delete(self, ids: DataFrame | None = None, id_col: str = "id") -> int:
        """Delete by key (None: all rows); how many rows went."""
        gone = [0]

        def make(base: Version) -> Version | None:
            stored = self._rows(base)
            if ids is None:
                gone[0] = stored.count()
                return Version(batches=base.batches) if base.parts else None
            wanted = ids.select(F.col(id_col).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
            hits = stored.join(wanted, self.key, "left_semi").groupBy(F.col(self.partition).cast("string").alias("v")) \
                .agg(F.count(F.lit(1)).alias("n")).collect()  # one row per stored partition at most
            gone[0] = sum(r.n for r in hits)
            if not hits:
                return None
            touched = {NULL_PARTITION if r.v is None else r.v for r in hits}
            rest, left = self._increment(self._rows(base, touched).join(wanted, self.key, "left_anti"))
            parts = {v: x for v, x in base.parts.items() if v not in touched} | {v: [rest] for v in left}
            return Version(parts=parts, batches=base.batches)

        self._change(make)
        return gone[0]

    def reset(self) -> Version:
        """An empty version; the ones before stay readable, streams start anew."""
        return self._change(lambda base: Version())

    def compact(self) -> Version:
        """Partitions that lie in several increments are written into one."""
        def make(base: Version) -> Version | None:
            many = {v for v, x in base.parts.items() if len(x) > 1}
            if not many:
                return None
            name, left = self._increment(self._rows(base, many))
            return Version(parts={v: x for v, x in base.parts.items() if v not in many} | {v: [name] for v in left},
                           batches=base.batches)
        return self._change(make)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the increments that none of these has; how many increments
        went. Not for tables that others write to at the same time."""
        kept = self.numbers()[-keep:]
        needed = {i for n in kept for x in self.version(n).parts.values() for i in x}
        for n in set(self.numbers()) - set(kept):
            fs, at = self._fs(f"{self.path}/versions/{n:020d}.json")
            fs.delete(at, False)
        loose = [n for n in self._names(f"{self.path}/data") if n.split("=", 1)[-1] not in needed]
        for n in loose:
            fs, at = self._fs(f"{self.path}/data/{n}")
            fs.delete(at, True)
        return len(loose)


def log_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path)


def vector_table(spark: SparkSession, path: str) -> SnapshotTable:
    """K2: stored vectors; ``reset`` empties the collection."""
    return SnapshotTable(spark, path, VECTOR_SCHEMA, "event_month", order="timestamp")


def store_vectors(table: SnapshotTable, vectors: DataFrame, stream: str | None = None, batch: int | None = None) -> Version:
    """Upsert (id, embedding, document, severity, source, hostname, timestamp, log_type) rows."""
    return table.upsert(vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
                        .withColumn("event_date", F.to_date("timestamp"))
                        .withColumn("event_month", F.trunc("timestamp", "month")), stream, batch)


def embed_pending(logs: SnapshotTable, vectors: SnapshotTable, embedder=None, limit: int | None = None) -> int:
    """V3: embed stored logs that have no stored vector, oldest first (``limit``: so many of them); how many."""
    from sieveline.operators.search import unembedded
    from sieveline.operators.vectors import embed_logs
    from sieveline.sources.scratch import written
    stored, known = logs.read(), vectors.read().select("id")
    pending = stored.join(known, "id", "left_anti") if limit is None else unembedded(stored, known, limit)
    pending = written(pending, "pending-logs")
    n = pending.count()
    if n:
        store_vectors(vectors, embed_logs(pending, embedder))
    return n
