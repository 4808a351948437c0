"""Processing only what is new or changed: versioned tables, their manifests and the deltas between two versions.

A table is a folder of immutable Parquet files. Version N is ``_versions/N.json``: the data files that belong to it, and its
deletion vectors (Parquet files with row keys). Every row of either carries the version that wrote it, and a vector covers
the rows that older versions wrote under its keys; so a read is one scan of the data and at most one join with all vectors
together, however many commits there were. A version is made visible by creating its manifest, which fails if the number
is taken, so a commit happens wholly or not at all.

The changes between two versions follow from the two manifests: rows of files only in the newer one are additions, rows of
files only in the older one and rows newly covered by a deletion vector are removals; files in both are opened only where
fresh vectors cover rows of them. Versions that only rewrote files (compaction) are no change; where one lies between, or
a version replaced all rows by a new delivery, rows that both sides have are set off against each other.

A consumer keeps the source version it has processed in the manifest of its own output, in the commit that adds the
output's files. A run that dies before that commit leaves files no manifest names; the next run starts from the same
source version, so nothing is skipped and nothing counted twice.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.session import small

SUCCEEDED = "succeeded"
#: The column of all files of a table that says which version wrote a row.
WRITTEN = "_written_by"
#: A run log is read by the driver; more runs than this and it is no run log.
MAX_RUNS = 100_000


class CommitConflict(RuntimeError):
    """Another writer took the version number first."""


@dataclass
class Manifest:
    """One version: its data files and deletion vectors, the versions up to it that only rewrote files (``rewrites``) or
    delivered all rows anew (``replaced``); ``meta`` is free."""

    version: int
    files: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)
    replaced: list[int] = field(default_factory=list)
    meta: dict[str, object] = field(default_factory=dict)


@dataclass
class Delta:
    """Rows that came and rows that went between two versions."""

    added: DataFrame
    removed: DataFrame


class VersionedTable:
    """A folder of immutable Parquet files with numbered manifests, on any file system Hadoop can reach.

    ``key`` names the column that deletion vectors refer to. Rows with a null key can be added, never deleted by key.
    Manifests are published by a link (local folders) or a rename that never overwrites, so of two writers one fails; on
    object stores without such a rename only one writer may commit at a time. In a ``distinct`` table equal rows, also of
    several versions, count once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, distinct: bool = False):
        self.spark, self.path, self.schema, self.key, self.distinct = spark, path.rstrip("/"), schema, key, distinct

    # -- manifests ------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def latest(self) -> int:
        """The highest committed version, 0 for a table without commits."""
        fs, p = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version (the latest by default); version 0 is empty."""
        version = self.latest() if version is None else version
        if version == 0:
            return Manifest(0)
        fs, p = self._fs(f"{self.path}/_versions/{version:012d}.json")
        stream = fs.open(p)
        try:
            raw = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return Manifest(**json.loads(raw.decode()))

    def publish(self, manifest: Manifest) -> int:
        """Make a version visible, or fail if its number is taken; a reader never sees half a manifest."""
        fs, p = self._fs(f"{self.path}/_versions/{manifest.version:012d}.json")
        _, tmp = self._fs(f"{self.path}/_staged/{uuid.uuid4().hex}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(asdict(manifest), ensure_ascii=False).encode()))
        out.close()
        fs.mkdirs(p.getParent())
        try:
            if fs.getScheme() == "file":
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
            else:
                jvm = self.spark.sparkContext._jvm
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, none)
        except Exception as e:
            if fs.exists(p):
                raise CommitConflict(f"version {manifest.version} of {self.path} exists") from e
            raise
        finally:
            fs.delete(tmp, False)
        return manifest.version

    # -- writing --------------------------------------------------------------------------------------------------

    def stored(self, folder: str) -> list[str]:
        """The Parquet files of a folder and the folders in it."""
        fs, p = self._fs(folder)
        out, at = [], fs.listFiles(p, True)
        while at.hasNext():
            s = at.next()
            if s.getPath().getName().endswith(".parquet") and s.getLen():
                out.append(s.getPath().toString())
        return sorted(out)

    def _write(self, df: DataFrame, kind: str, version: int) -> list[str]:
        folder = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        df.withColumn(WRITTEN, F.lit(version).cast("long")).write.parquet(folder)
        return self.stored(folder)

    def commit(self, added: DataFrame | None = None, deleted_keys: DataFrame | None = None, drop_files: Sequence[str] = (), meta: dict | None = None, base: int | None = None, rewrite: bool = False, replace: bool = False) -> int:
        """Publish the next version: the files of ``base`` (the latest) without ``drop_files``, a deletion vector over them
        for ``deleted_keys``, and the rows of ``added`` as new files. ``replace`` drops all files, as ``added`` is the whole
        table delivered anew; ``rewrite`` says the same of rows that are those of ``base``."""
        now = self.manifest(base)
        version, files, vectors = now.version + 1, [], []
        if not (replace or rewrite):
            dropped = set(drop_files)
            files, vectors = [f for f in now.files if f not in dropped], list(now.vectors)
            if deleted_keys is not None and files:
                vectors += self._write(deleted_keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct(), "deleted", version)
            if not files:
                vectors = []
        if added is not None:
            files += self._write(added.select(*self.schema.fieldNames()), "data", version)
        rewrites, replaced = now.rewrites + [version] * rewrite, now.replaced + [version] * replace
        return self.publish(Manifest(version, files, vectors, rewrites, replaced, {**now.meta, **(meta or {})}))

    def vacuum(self) -> int:
        """Delete the data and vectors that the latest version doesn't name, those of runs that died too. Earlier versions
        can't be read any more; no writer may be at work meanwhile. Returns the number of files."""
        m, gone = self.manifest(), 0
        kept = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in (*m.files, *m.vectors)}
        for kind in ("data", "deleted"):
            fs, p = self._fs(f"{self.path}/{kind}")
            if fs.exists(p):
                for f in self.stored(p.toString()):
                    if f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] not in kept:
                        fs.delete(self._fs(f)[1], False)
                        gone += 1
        return gone

    # -- reading --------------------------------------------------------------------------------------------------

    @cached_property
    def _with_version(self) -> StructType:
        return StructType([*self.schema.fields, StructField(WRITTEN, LongType())])

    def _covered(self, vectors: list[str]) -> DataFrame:
        """Per key the newest version that deleted it."""
        schema = StructType([self.schema[self.key], StructField(WRITTEN, LongType())])
        return self.spark.read.schema(schema).parquet(*vectors).groupBy(self.key).agg(F.max(WRITTEN).alias("_gone"))

    def _live(self, files: list[str], vectors: list[str]) -> DataFrame:
        """The rows of some files, with their versions, that no vector covers."""
        if not files:
            return self.spark.createDataFrame([], self._with_version)
        rows = self.spark.read.schema(self._with_version).parquet(*files)
        if vectors:
            rows = rows.join(self._covered(vectors), self.key, "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col(WRITTEN)))
        return rows.select(*self._with_version.fieldNames())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        rows = self._live(m.files, m.vectors).drop(WRITTEN)
        return rows.distinct() if self.distinct else rows

    def changes(self, since: int, until: int | None = None) -> Delta:
        """Rows added and removed between two versions."""
        new = self.manifest(until)
        rewrites, until = set(new.rewrites), new.version
        while since + 1 in rewrites and since < until:
            since += 1
        while until in rewrites and since < until:
            until -= 1
        old, new = self.manifest(since), new if until == new.version else self.manifest(until)
        before, after = set(old.files), set(new.files)
        added = self._live([f for f in new.files if f not in before], new.vectors).drop(WRITTEN)
        removed = self._live([f for f in old.files if f not in after], old.vectors).drop(WRITTEN)
        fresh, kept = [v for v in new.vectors if v not in set(old.vectors)], [f for f in old.files if f in after]
        if fresh and kept:
            hit = self._live(kept, old.vectors).join(self._covered(fresh), self.key).where(F.col("_gone") > F.col(WRITTEN))
            removed = removed.unionByName(hit.select(*self.schema.fieldNames()))
        if self.distinct:
            return Delta(*self._net(added, removed, old, new))
        if any(since < v <= until for v in (*new.rewrites, *new.replaced)):
            added, removed = added.exceptAll(removed), removed.exceptAll(added)
        return Delta(added, removed)


    def _net(self, added: DataFrame, removed: DataFrame, old: Manifest, new: Manifest) -> tuple[DataFrame, DataFrame]:
        """The same for a set of rows: what came is in no older file that counts, what went in none of the newer version."""
        kept = self._live([f for f in new.files if f in set(old.files)], new.vectors).drop(WRITTEN)
        return added.subtract(removed.unionByName(kept)), removed.subtract(added.unionByName(kept))


def process_new(source: VersionedTable, output: VersionedTable, step: Callable[[Delta], tuple[DataFrame | None, DataFrame | None]]) -> int | None:
    """Run ``step`` on what changed in ``source`` since the version noted in ``output`` and commit its result.

    ``step`` returns rows to add to the output and keys to delete from it. The processed source version is part of the
    output's commit. Returns the output's new version, or None if the source has no new version. A failure in ``step``
    or before the commit changes nothing that a reader or the next run can see.
    """
    done = output.manifest()
    since, until = int(done.meta.get("processed", 0)), source.latest()
    if since == until:
        return None
    a, b = source.manifest(since), source.manifest(until)
    if since and (a.files, a.vectors) == (b.files, b.vectors):  # only metadata changed
        return output.commit(meta={"processed": until}, base=done.version)
    add, delete = step(source.changes(since, until))
    return output.commit(add, delete, meta={"processed": until}, base=done.version)


# -- a run log and its records as versions -------------------------------------------------------------------------------


def committed_runs(runs: DataFrame, run_id: str = "run_id", status: str = "status") -> list[int]:
    """The runs of a log that succeeded, in order. Runs that failed, were cancelled or still run never published a manifest,
    so whatever they wrote belongs to no version. Null ids or statuses commit nothing."""
    rows = runs.where((F.col(status) == SUCCEEDED) & F.col(run_id).isNotNull()).select(F.col(run_id)).distinct().limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs")
    return sorted(int(r[0]) for r in rows)


def import_log(table: VersionedTable, records: DataFrame, runs: DataFrame, key: str = "key", run_id: str = "run_id", action: str = "action") -> int:
    """Bring the committed runs of a log that ``table`` (one column, ``key``) doesn't have yet into it as versions.

    Run by run, a version adds the keys it put, in lower case, as new files, and the next one covers the keys it dropped
    with a deletion vector, which hides all files up to then; so if one run both put and dropped a key, the vector wins.
    The records of all these runs are read once, by one filter on their ids, and written once. Which runs a table has
    stands in its manifest. If a run turns up that is older than one already there, the versions are built anew. Null keys
    and other actions are left out; repeated records change nothing. Returns the latest version.
    """
    now, committed = table.manifest(), committed_runs(runs, run_id)
    known = list(now.meta.get("runs", []))
    fresh = [r for r in committed if r not in set(known)]
    if known and fresh and fresh[0] < known[-1] or set(known) - set(committed):
        now, known, fresh = Manifest(now.version, [], [], now.rewrites, now.replaced, now.meta), [], committed
    if not fresh:
        return now.version
    first = {r: now.version + 1 + 2 * i for i, r in enumerate(fresh)}
    spark = table.spark
    at = spark.createDataFrame(list(first.items()), "_run long, _first long")
    rows = records.select(F.lower(key).alias("key"), F.col(run_id).cast("long").alias("_run"), F.col(action).alias("_action"))
    rows = rows.where(F.col("key").isNotNull() & F.col("_action").isin("put", "drop") & F.col("_run").between(fresh[0], fresh[-1])).join(small(at), "_run")
    rows = rows.select("key", (F.col("_first") + (F.col("_action") == "drop").cast("long")).alias(WRITTEN)).distinct()
    folder = f"{table.path}/log/{uuid.uuid4().hex}"
    # rebalanced, so that a run with a third of the records is written by several tasks and a small one by one
    rows.withColumn("_v", F.col(WRITTEN)).hint("rebalance", "_v").write.partitionBy("_v").parquet(folder)
    written: dict[int, list[str]] = {}
    for f in table.stored(folder):
        written.setdefault(int(f.rsplit("/_v=", 1)[1].split("/")[0]), []).append(f)
    files, vectors, version = list(now.files), list(now.vectors), now.version
    rebuilt = [now.version + 1] if now.version and not known else []
    for r in fresh:
        files += written.get(first[r], [])
        known.append(r)
        version = table.publish(Manifest(version + 1, files, vectors, now.rewrites, now.replaced + rebuilt, {**now.meta, "runs": known}))
        vectors = vectors + written.get(version + 1, [])
        version = table.publish(Manifest(version + 1, files, vectors, now.rewrites, now.replaced + rebuilt, {**now.meta, "runs": known}))
    return version


def pending(current: DataFrame, records: DataFrame, runs: DataFrame, path: str) -> Delta:
    """What the next run has to hand over (``added``) and to take back (``removed``): the keys by which the current snapshot
    differs from the last committed version of the log, each once, in lower case.

    ``current`` has a column ``key``; case doesn't matter, null keys are left out. The log's runs become versions of a table
    under ``path`` (see import_log), the snapshot its next version, delivered whole; the delta of the two is taken by
    process_new into an output whose commit notes the version. A log without committed runs makes everything pending. If
    ``path`` has versions already, only runs that came since are read and only the log's side is built on; a call that
    died leaves no version. Both sides are aggregated by key, so a key that fills a third of the rows is one row a task.
    """
    spark = current.sparkSession
    schema = StructType.fromDDL("key string")
    log, shown = VersionedTable(spark, f"{path}/log", schema, "key", True), VersionedTable(spark, f"{path}/shown/{uuid.uuid4().hex}", schema, "key", True)
    handed = log.manifest(import_log(log, records, runs))
    start = shown.publish(Manifest(1, handed.files, handed.vectors))
    shown.commit(current.select(F.lower("key").alias("key")).where(F.col("key").isNotNull()).distinct(), replace=True)
    kinds = StructType.fromDDL("key string, change string")
    out = VersionedTable(spark, f"{path}/pending/{uuid.uuid4().hex}", kinds, "key")
    out.commit(meta={"processed": start})
    mark = lambda df, change: df.withColumn("change", F.lit(change))
    process_new(shown, out, lambda d: (mark(d.added, "added").unionByName(mark(d.removed, "removed")), None))
    rows = out.read()
    return Delta(*(rows.where(F.col("change") == c).select("key") for c in ("added", "removed")))
