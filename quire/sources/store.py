"""The stored corpus: versions of lines with staged changes that only a commit makes visible."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.incremental import VersionedTable
from quire.sources.books import STORED, order_book_numbers, with_ids
from quire.operators.corpus import number_books
from quire.session import cut

SCHEMA_VERSION, TOKENIZER_VERSION = 11, 1
COMPATIBLE, LEGACY, REBUILD, TOO_OLD, NO_INDEX, INVALID = "compatible", "legacy_compatible", "rebuild_required", "engine_too_old", "missing_index", "invalid_index_path"


class Store:
    """Lines under ``path``. Changes are staged in order and published together; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        schema = StructType.fromDDL(STORED)
        self.table = VersionedTable(spark, path, schema, "id")
        self._high = 0
        self.rollback()

    # -- reading ----------------------------------------------------------------------------------------------------

    def lines(self, version: int | None = None) -> DataFrame:
        """The committed lines."""
        return self.table.read(version)

    def pending(self) -> DataFrame:
        """The lines as the next commit will have them."""
        now = self.lines().limit(0) if self._cleared else self.lines()
        if self._removed is not None:
            now = now.join(self._removed.distinct(), "id", "left_anti").select(*now.columns)
        return now if self._added is None else now.unionByName(self._added)

    def snapshot(self) -> tuple[int, int]:
        """What identifies the visible state: version and revision of the order mapping."""
        m = self.table.manifest()
        return m.version, int(m.meta.get("order_revision", 0))

    def _numbers(self) -> tuple[DataFrame | None, int]:
        high = int(self.table.manifest().meta.get("book_high_water", 0))
        return order_book_numbers(self.pending()), max(high, self._high)

    # -- staging ----------------------------------------------------------------------------------------------------

    def add(self, lines: DataFrame) -> int:
        """Stage lines of books (the layout of sources.books); their books get numbers. Returns how many lines."""
        known, high = self._numbers()
        numbers = cut(number_books(lines, known, high))
        self._high = max(high, numbers.agg(F.max("book_no")).first()[0] or 0)
        if self._high >= 1 << 31:
            raise ValueError("book numbers are exhausted")
        rows = cut(with_ids(lines, numbers))
        self._stage(rows)
        return rows.count()

    def _stage(self, rows: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        if removed is not None:
            self._removed = removed if self._removed is None else self._removed.unionByName(removed)
        if rows is not None:
            self._added = rows if self._added is None else self._added.unionByName(rows)

    def upsert(self, lines: DataFrame) -> int:
        """Stage lines in place of those with the same id. Of repeated ids in one call any one counts."""
        known, high = self._numbers()
        numbers = cut(number_books(lines, known, high))
        self._high = max(high, numbers.agg(F.max("book_no")).first()[0] or 0)
        rows = cut(with_ids(lines, numbers).dropDuplicates(["id"]))
        if self._added is not None:
            self._added = self._added.join(rows.select("id"), "id", "left_anti").select(*rows.columns)
        self._stage(rows, rows.select("id"))
        return rows.count()

    def upsert_books(self, lines: DataFrame) -> int:
        """Stage whole books in place of those with the same path: lines the new text no longer has go too. The paths of one
        call are read by the driver, as those of delete() are."""
        paths = [r[0] for r in lines.select("file_path").distinct().collect()]
        self.delete(file_paths=paths)
        return self.add(lines)

    def set_order(self, order: DataFrame) -> int:
        """Replace the mapping of books to their orders: stored beside the lines, named by the commit that brings it in.
        Returns its revision, which grows only on a change."""
        rows = order.select("file_path", "catalogue_order", "generation_order")
        digest = rows.select(F.sum(F.xxhash64("file_path", "catalogue_order", "generation_order").cast("decimal(38,0)"))).first()[0]
        now = self.table.manifest()
        if now.meta.get("order_digest") == str(digest):
            return int(now.meta["order_revision"])
        folder, revision = f"{self.table.path}/order/{uuid.uuid4().hex}", int(now.meta.get("order_revision", 0)) + 1
        rows.write.parquet(folder)
        self.table.commit(meta={"order_digest": str(digest), "order_revision": revision, "order": folder}, base=now.version)
        return revision

    def order(self) -> DataFrame | None:
        """The stored mapping of books to their orders."""
        folder = self.table.manifest().meta.get("order")
        return self.spark.read.schema("file_path string, catalogue_order int, generation_order int").parquet(folder) if folder else None

    def delete(self, ids: list[int] | None = None, file_paths: list[str] | None = None, titles: list[str] | None = None) -> None:
        """Stage the removal of lines by id, by book or by title."""
        gone = [F.col(c).isin(list(v)) for c, v in (("id", ids), ("file_path", file_paths), ("title", titles)) if v]
        if gone:
            hit = F.coalesce(reduce(lambda a, b: a | b, gone), F.lit(False))
            if self._added is not None:
                self._added = self._added.where(~hit)
            self._stage(removed=self.lines().where(hit).select("id"))

    def clear(self) -> None:
        """Stage the removal of everything, what is staged included."""
        self.rollback()
        self._cleared = True

    def rollback(self) -> None:
        """Forget what is staged."""
        self._added: DataFrame | None = None
        self._removed: DataFrame | None = None
        self._cleared = False

    def commit(self, **extra: object) -> int:
        """Publish what is staged: new files, and a deletion vector over the files that stay. Only changed rows are
        written; nothing that stays is read. ``extra`` metadata is part of the same commit. Returns the version."""
        if self._added is None and self._removed is None and not self._cleared:
            return self.table.commit(meta=extra) if extra else self.table.latest()
        now = self.table.manifest()
        meta = {"schema_version": SCHEMA_VERSION, "tokenizer_version": TOKENIZER_VERSION, "book_high_water": max(self._high, int(now.meta.get("book_high_water", 0))), **extra}
        version = self.table.commit(self._added, self._removed, list(now.files) if self._cleared else (), meta, now.version)
        self.rollback()
        return version

    def set_meta(self, **meta: object) -> int:
        """A commit that only changes metadata."""
        return self.table.commit(meta=meta)

    def compact(self, rows_per_file: int = 1_000_000) -> int:
        """Rewrite the current version without deletion vectors, in few files of even size, clustered by id."""
        base = self.table.latest()
        now = cut(self.lines(base))
        n = max(1, -(-now.count() // rows_per_file))
        return self.table.commit(now.repartitionByRange(n, "id").sortWithinPartitions("id"), base=base, rewrite=True)

    def file_count(self) -> int:
        return len(self.table.manifest().files)


def compatibility(spark: SparkSession, path: str) -> str:
    """Whether a stored corpus can be read: by its own metadata, nothing is inferred from its files."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return NO_INDEX
    if fs.getFileStatus(p).isFile():
        return INVALID
    m = Store(spark, path).table.manifest()
    if m.version == 0:
        return NO_INDEX
    schema = int(m.meta.get("schema_version", 0))
    if schema > SCHEMA_VERSION or int(m.meta.get("tokenizer_version", 0)) > TOKENIZER_VERSION:
        return TOO_OLD
    return COMPATIBLE if schema == SCHEMA_VERSION else LEGACY if schema == SCHEMA_VERSION - 1 else REBUILD


def difference(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, change): rows that are ``added``, ``removed`` or ``changed`` between two tables with unique keys."""
    a, b = (x.select(F.col(key), F.xxhash64(*columns).alias(n)) for x, n in ((old, "_a"), (new, "_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")
