"""Table set on plain Parquet with a commit ledger.

    <root>/changelog/epoch=E/batch=B     every row image of the batch
    <root>/current/epoch=E/batch=B       last image per key within the batch
    <root>/dead_letters/epoch=E/batch=B
    <root>/base/epoch=E/upto=B           last image per key up to B (compacted)
    <root>/base_commits/epoch=E/upto=B   one row, written after the base
    <root>/commits/epoch=E/batch=B       one row, written last
    <root>/gate/epoch=E/batch=B          admission state of the keys of the batch
    <root>/isolated/epoch=E/batch=B      records that the gate keeps apart
    <root>/patches/epoch=E/batch=P       row images from outside the stream, by patch
    <root>/repairs, repair_letters/...   attempts of a patch and what failed in it
    <root>/patch_commits/epoch=E/batch=P one row, written after the patch

A batch or base without its ledger row is invisible. Writing an uncommitted batch again
replaces its folders, so a retried micro-batch cannot double its rows; a committed one is
left alone. Batches of an epoch
commit in order, so readers need only the newest committed batch id and prune
folders by it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.state import latest_per_key
from tidemark.schemas import (
    CHANGE,
    COMMIT,
    DEAD_LETTER,
    DELETE,
    GATE,
    ISOLATED,
    ORDER_COLUMNS,
    PATCH_COMMIT,
    REPAIR,
)

_PARTS = [
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("batch", T.LongType(), False),
]
_BASE_PARTS = [_PARTS[0], T.StructField("upto", T.LongType(), False)]
DATASETS = {
    "changelog": T.StructType([*CHANGE.fields, *_PARTS]),
    "current": T.StructType([*CHANGE.fields, *_PARTS]),
    "dead_letters": T.StructType([*DEAD_LETTER.fields, *_PARTS]),
    "commits": T.StructType([*COMMIT.fields, *_PARTS]),
    "gate": T.StructType([*GATE.fields, *_PARTS]),
    "isolated": T.StructType([*ISOLATED.fields, *_PARTS]),
    "patches": T.StructType([*CHANGE.fields, *_PARTS]),
    "repairs": T.StructType([*REPAIR.fields, *_PARTS]),
    "repair_letters": T.StructType([*DEAD_LETTER.fields, *_PARTS]),
    "patch_commits": T.StructType([*PATCH_COMMIT.fields, *_PARTS]),
    "base": T.StructType([*CHANGE.fields, *_BASE_PARTS]),
    "base_commits": T.StructType([T.StructField("rows", T.LongType(), False), *_BASE_PARTS]),
}
_NOTHING = -1


@dataclass(frozen=True)
class TableSet:
    """The tables below ``root``; ``epoch`` is one lineage of batches.

    ``file_rows`` limits the rows of a file, ``row_group_bytes`` the size of its row groups,
    in every write; unset, Spark's own limits hold.
    """

    spark: SparkSession
    root: str
    epoch: int = 0
    file_rows: int | None = None
    row_group_bytes: int | None = None

    # -- layout -----------------------------------------------------------------

    def ensure(self) -> TableSet:
        """Create the folders of missing datasets; an empty folder reads as an empty table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in DATASETS:
            fs.mkdirs(path(f"{self.root}/{name}"))
        return self

    def next_epoch(self) -> TableSet:
        """Fresh lineage for a rebuild or redelivery; the old one stays readable."""
        return replace(self, epoch=self.epoch + 1).ensure()

    def scan(self, dataset: str) -> DataFrame:
        """All rows of the dataset, committed or not, of every epoch."""
        return self.spark.read.schema(DATASETS[dataset]).parquet(f"{self.root}/{dataset}")

    # -- ledger -----------------------------------------------------------------

    def commits(self) -> DataFrame:
        return self.scan("commits").where(F.col("epoch") == self.epoch)

    def newest_commit(self) -> tuple[int, dict[str, int]]:
        """Newest committed batch id, -1 before the first commit, and the offsets after it."""
        newest = self.commits().agg(F.max_by(F.struct("batch", "offsets"), "batch").alias("c")).first().c
        return (_NOTHING, {}) if newest is None else (newest.batch, dict(newest.offsets))

    def last_batch(self) -> int:
        """Newest committed batch id, -1 before the first commit."""
        newest = self.commits().agg(F.max("batch").alias("b")).first().b
        return _NOTHING if newest is None else newest

    def patch_commits(self) -> DataFrame:
        return self.scan("patch_commits").where(F.col("epoch") == self.epoch)

    def last_patch(self, upto: int | None = None) -> int:
        """Newest committed patch that a snapshot shows, -1 if it shows none."""
        rows = self.patch_commits()
        if upto is not None:
            rows = rows.where(F.col("after_batch") <= F.lit(upto))
        newest = rows.agg(F.max("batch").alias("p")).first().p
        return _NOTHING if newest is None else newest

    def snapshot_history(self) -> DataFrame:
        """Snapshots ordered by commit time, then id."""
        return self.commits().select(
            F.col("batch").alias("snapshot_id"),
            F.col("committed_at_ms").alias("committed_at_epoch_ms"),
        ).orderBy("committed_at_epoch_ms", "snapshot_id")

    # -- readers ----------------------------------------------------------------

    def committed(self, dataset: str, upto: int | None = None) -> DataFrame:
        newest = self.last_batch()
        upto = newest if upto is None else min(upto, newest)
        return self.scan(dataset).where(
            (F.col("epoch") == self.epoch) & (F.col("batch") <= F.lit(upto))
        )

    def patched(self, dataset: str, upto: int | None = None) -> DataFrame:
        """Rows of committed patches. They commit in order, so readers prune folders by the newest."""
        return self._until_patch(dataset, self.last_patch(upto))

    def _until_patch(self, dataset: str, newest: int) -> DataFrame:
        return self.scan(dataset).where((F.col("epoch") == self.epoch) & (F.col("batch") <= F.lit(newest)))

    def _with_patches(self, images: DataFrame, upto: int | None) -> DataFrame:
        newest = self.last_patch(upto)
        if newest == _NOTHING:
            return images
        return images.unionByName(self._until_patch("patches", newest).select(*images.columns))

    def changelog(self, upto: int | None = None) -> DataFrame:
        return self._with_patches(self.committed("changelog", upto), upto)

    def dead_letters(self) -> DataFrame:
        """Dead letters, once per record however often its delivery was repeated."""
        return self.committed("dead_letters").dropDuplicates(
            ["original_topic", "original_partition", "original_offset"]
        )

    def _newest_base(self, upto: int) -> int:
        newest = (
            self.scan("base_commits")
            .where((F.col("epoch") == self.epoch) & (F.col("upto") <= F.lit(upto)))
            .agg(F.max("upto").alias("u"))
            .first()
            .u
        )
        return _NOTHING if newest is None else newest

    def latest_images(self, upto: int | None = None) -> DataFrame:
        """Last image per key at a snapshot, deletes included: base plus later batches."""
        newest = self.last_batch()
        upto = newest if upto is None else min(upto, newest)
        start = self._newest_base(upto)
        columns = CHANGE.fieldNames()
        deltas = self.committed("current", upto).where(F.col("batch") > F.lit(start))
        images = deltas.select(*columns)
        if start != _NOTHING:
            base = self.scan("base").where(
                (F.col("epoch") == self.epoch) & (F.col("upto") == F.lit(start))
            )
            images = base.select(*columns).unionByName(images)
        # a base may hold some of the patches: a position occurs once in what follows anyway
        return latest_per_key(self._with_patches(images, upto))

    def current(self, upto: int | None = None) -> DataFrame:
        """Live rows, newest snapshot or the one given (time travel)."""
        return (
            self.latest_images(upto)
            .where(F.col("cdc_row_kind") != DELETE)
            .select(*ORDER_COLUMNS)
        )

    # -- writers ----------------------------------------------------------------

    def write_rows(self, rows: DataFrame, path: str) -> None:
        """Replace a folder, within the limits on files and row groups."""
        limits = {"maxRecordsPerFile": self.file_rows, "parquet.block.size": self.row_group_bytes}
        rows.write.mode("overwrite").options(**{k: v for k, v in limits.items() if v is not None}).parquet(path)

    def write_part(self, dataset: str, batch_id: int, rows: DataFrame) -> None:
        columns = DATASETS[dataset].fieldNames()[:-2]
        self.write_rows(rows.select(*columns), f"{self.root}/{dataset}/epoch={self.epoch}/batch={batch_id}")

    def files(self, dataset: str) -> DataFrame:
        """(path, size_bytes, manifest, number) of the files of this lineage, committed or not.

        Files are listed, not read; the folder stands for the manifest, ``number`` is its batch.
        """
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/{dataset}")
        here = listed.where(F.contains("path", F.lit(f"/epoch={self.epoch}/")))
        folder = F.regexp_replace("path", "/[^/]*$", "")
        return here.select(
            "path",
            F.col("length").alias("size_bytes"),
            folder.alias("manifest"),
            F.substring_index(folder, "=", -1).cast("bigint").alias("number"),
        )

    def commit_base(self, upto: int, rows: int) -> None:
        """Make a base visible."""
        self.spark.range(1).coalesce(1).select(F.lit(rows).cast("bigint").alias("rows")).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/base_commits/epoch={self.epoch}/upto={upto}")

    def offsets(self) -> dict[str, int]:
        """Next offset per ``topic:partition`` after the newest commit."""
        return self.newest_commit()[1]

    def _write_row(self, dataset: str, number: int, schema: T.StructType, values: dict[str, Column]) -> None:
        row = self.spark.range(1).coalesce(1).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
        self.write_part(dataset, number, row)

    def commit(
        self,
        batch_id: int,
        changelog_rows: int,
        dead_rows: int,
        offsets: dict[str, int],
        before: dict[str, int] | None = None,
    ) -> None:
        """Make a batch visible; ``offsets`` are added to those of the commit ``before``."""
        before = self.offsets() if before is None else before
        values = {
            "batch_id": F.lit(batch_id),
            "committed_at_ms": F.lit(int(time.time() * 1000)),
            "offsets": _vector({**before, **offsets}),
            "changelog_rows": F.lit(changelog_rows),
            "dead_letter_rows": F.lit(dead_rows),
        }
        self._write_row("commits", batch_id, COMMIT, values)

    def commit_patch(
        self, patch: int, kind: str, name: str, rows: int, low: dict[str, int] | None = None, high: dict[str, int] | None = None
    ) -> None:
        """Make a patch visible from the newest batch on; ``low`` and ``high`` are marks in the log."""
        values = {
            "kind": F.lit(kind),
            "name": F.lit(name),
            "committed_at_ms": F.lit(int(time.time() * 1000)),
            "after_batch": F.lit(self.last_batch()),
            "rows": F.lit(rows),
            "low": _vector(low or {}),
            "high": _vector(high or {}),
        }
        self._write_row("patch_commits", patch, PATCH_COMMIT, values)


def _vector(offsets: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in sorted(offsets.items()) for x in item]
    return F.create_map(*pairs) if pairs else F.create_map()


def latest_snapshots(histories: DataFrame, expected: DataFrame) -> DataFrame:
    """Newest snapshot id per table; a table without any fails the job.

    ``histories`` has (table_name, snapshot_id, committed_at_epoch_ms), ``expected`` table_name.
    """
    newest = histories.groupBy("table_name").agg(
        F.max_by("snapshot_id", F.struct("committed_at_epoch_ms", "snapshot_id")).alias("snapshot_id")
    )
    return expected.select("table_name").distinct().join(newest, "table_name", "left").select(
        "table_name",
        F.coalesce(
            "snapshot_id",
            F.raise_error(F.concat(F.lit("no snapshot for table "), F.col("table_name"))).cast("bigint"),
        ).alias("snapshot_id"),
    )


def snapshot_summary(histories: DataFrame, files: DataFrame) -> DataFrame:
    """Per table: snapshots, current id, and delete files in total and of the newest commit.

    ``files`` has (table_name, snapshot_id, content) with content data or deletes.
    """
    known = histories.select("table_name", "snapshot_id", "committed_at_epoch_ms", F.lit(0).alias("d"), F.lit(0).alias("n"))
    listed = files.select(
        "table_name",
        "snapshot_id",
        F.lit(None).cast("bigint").alias("committed_at_epoch_ms"),
        (F.col("content") == "deletes").cast("int").alias("d"),
        F.lit(1).alias("n"),
    )
    per_commit = known.unionByName(listed).groupBy("table_name", "snapshot_id").agg(
        F.max("committed_at_epoch_ms").alias("at"), F.sum("d").alias("d"), F.sum("n").alias("n")
    )
    place = F.when(F.col("at").isNotNull(), F.struct("at", "snapshot_id"))
    return (
        per_commit.groupBy("table_name")
        .agg(
            F.count("at").alias("snapshot_count"),
            F.max_by("snapshot_id", place).alias("current_snapshot_id"),
            F.sum("n").alias("total_files"),
            F.sum("d").alias("total_delete_files"),
            F.coalesce(F.max_by("d", place), F.lit(0)).cast("bigint").alias("added_delete_files"),
        )
        .where("snapshot_count > 0")
    )
