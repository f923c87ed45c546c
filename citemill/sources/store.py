"""The chunk table on disk: appended versions and logs of what is live.

Layout below the store's root::

    chunks/version=N/   chunks written by publish N (never rewritten)
    live/               log (see deltas.py): document_name, stamp, version
    manifest/           log: absolute_path, modified_ms

A publish first appends chunks and then its delta of ``live``, one row per processed
document. That write switches readers over, a run that dies before it leaves nothing
visible, and both cost what was processed, whatever the store holds. A document's
row with the greatest stamp counts and says in which version its chunks are. Versions
without a live document are never scanned, and those in which all documents are live
are read without a join.

Every publish has a number of its own, so writers that overlap lose nothing: of two
publishes of one document the one with the greater number counts.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.sources.deltas import DeltaLog
from citemill.sources.files import MANIFEST_SCHEMA
from citemill.sources.paths import delete, exists, folder_times

LIVE_SCHEMA = "document_name string, stamp bigint, version bigint"
# A row group's filter on document names; with sorted rows it mostly has to refuse.
BLOOM = {
    "parquet.bloom.filter.enabled#document_name": "true",
    "parquet.bloom.filter.expected.ndv#document_name": "20000",
    "parquet.bloom.filter.max.bytes": "65536",
}
# Nothing filters by a vector's elements, of which a chunk has hundreds.
NO_BOUNDS = {"parquet.column.statistics.enabled#embedding.list.element": "false"}


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.live_log = DeltaLog(spark, f"{self.root}/live", LIVE_SCHEMA, "document_name", ("stamp", "version"))
        self.manifest_log = DeltaLog(spark, f"{self.root}/manifest", MANIFEST_SCHEMA, "absolute_path")

    def last_version(self) -> int:
        """Number of the last finished publish, -1 when there is none."""
        return self.live_log.last()

    def live(self, version: int | None = None) -> DataFrame:
        """document_name and the version that holds its chunks, as of a publish."""
        return self.live_log.current(version).drop("stamp")

    def _write(self, chunks: DataFrame, version: int) -> None:
        """One version's chunks, each file sorted by document, so that a lookup opens few row groups."""
        order = [c for c in ("document_name", "chunk_index") if c in chunks.columns]
        chunks.sortWithinPartitions(*order).write.mode("overwrite").options(**BLOOM, **NO_BOUNDS).parquet(self._folder(version))

    def _folder(self, version: int) -> str:
        return f"{self.root}/chunks/version={version}"

    def publish(self, chunks: DataFrame, processed: DataFrame, version: int | None = None) -> int:
        """Make ``chunks`` the live rows of the ``processed`` documents; a null name is a name.

        ``version`` lets a retried batch use the same number; a version that is
        already live is left as it is.
        """
        last = self.last_version()
        if version is not None and version <= last:
            return last
        version = self.live_log.claim() if version is None else version
        self._write(chunks, version)
        number = F.lit(version).cast("bigint")
        names = processed.select("document_name").distinct()
        self.live_log.append(names.select("document_name", number.alias("stamp"), number.alias("version")), version)
        return version

    def live_versions(self, version: int | None = None) -> dict[int, bool]:
        """Versions with live documents, and whether all documents of theirs are live."""
        counts = {r.version: r.n for r in self.live(version).groupBy("version").agg(F.count("*").alias("n")).collect()}
        written = self.live_log.sizes(list(counts))
        return {v: written.get(v) == n for v, n in sorted(counts.items())}

    def _scan(self, versions: list[int]) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.root}/chunks").parquet(*map(self._folder, versions))
        return read.withColumn("version", F.col("version").cast("bigint"))

    def read(self, version: int | None = None) -> DataFrame:
        """All live chunks, from the folders of live versions only.

        Where some documents of a version were replaced, its rows are matched with
        ``live``; no broadcast hint, since that grows with the documents.
        """
        if not exists(self.spark, f"{self.root}/chunks"):
            raise FileNotFoundError(f"nothing was published below {self.root}")
        whole = self.live_versions(version)
        all_live, some_live = ([v for v, every in whole.items() if every is kind] for kind in (True, False))
        if not whole:
            return self._scan([self.last_version()]).limit(0)
        frames = [self._scan(all_live)] if all_live else []
        if some_live:
            rows = self._scan(some_live)
            live = self.live(version).where(F.col("version").isin(some_live)).select(
                F.col("document_name").alias("live_name"), F.col("version").alias("live_version")
            )
            is_live = F.col("document_name").eqNullSafe(F.col("live_name")) & (F.col("version") == F.col("live_version"))
            frames.append(rows.join(live, is_live, "left_semi"))
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)

    def lookup(self, document_name: str | None, version: int | None = None) -> DataFrame:
        """Live chunks of one document: one version's folder, and there the row groups that may hold it."""
        name = F.lit(document_name).cast("string")
        row = self.live(version).where(F.col("document_name").eqNullSafe(name)).first()
        if row is None:
            return self._scan([self.last_version()]).limit(0)
        found = F.col("document_name").isNull() if document_name is None else F.col("document_name") == document_name
        return self._scan([row.version]).where(found)

    def version_rows(self, version: int) -> DataFrame:
        """The chunks that one publish wrote."""
        return self._scan([version])

    def compact(self) -> int:
        """Write the live rows of versions that also hold dead ones as one new version.

        Documents keep their stamps, so a publish that overlaps is not undone.
        """
        some_live = [v for v, every in self.live_versions().items() if not every]
        if not some_live:
            return self.last_version()
        version = self.live_log.claim()
        moved = self.live_log.current().where(F.col("version").isin(some_live))
        names = moved.select("document_name", F.col("version").alias("from_version"))
        rows = self._scan(some_live)
        is_moved = rows["document_name"].eqNullSafe(names["document_name"]) & (rows["version"] == names["from_version"])
        self._write(rows.join(names, is_moved, "left_semi").drop("version"), version)
        self.live_log.append(moved.select("document_name", "stamp", F.lit(version).cast("bigint").alias("version")), version)
        return version

    def vacuum(self, min_age_seconds: float = 7 * 86_400) -> list[int]:
        """Delete what no reader of the last version needs and is old enough; returns the dropped versions.

        Earlier versions can then no longer be read, and readers that started on them
        before must be done by that age.
        """
        self.live_log.fold()
        self.manifest_log.fold()
        live, now = self.live_versions(), time.time()
        dropped = []
        for path, changed in folder_times(self.spark, f"{self.root}/chunks").items():
            number = path.rsplit("version=", 1)[-1]
            if number.isdigit() and int(number) not in live and now - changed >= min_age_seconds:
                delete(self.spark, path)
                dropped.append(int(number))
        self.live_log.vacuum(min_age_seconds)
        self.manifest_log.vacuum(min_age_seconds)
        return sorted(dropped)

    def manifest(self) -> DataFrame:
        """The last known modification time of every path."""
        return self.manifest_log.current()

    def write_manifest(self, taken: DataFrame) -> int:
        """Note the modification times of files that were taken in; costs what they are."""
        number = self.manifest_log.claim()
        self.manifest_log.append(taken.select("absolute_path", "modified_ms"), number)
        return number
