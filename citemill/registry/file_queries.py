"""Scans, payloads, manifest, dispatch status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from citemill.operators.running import running_values
from citemill.operators.scan_status import dispatch_summary, scan_status
from citemill.plans.ingest import scan_and_ingest
from citemill.registry import inputs as given
from citemill.registry.catalog import register
from citemill.session import prepare_session, scratch_path
from citemill.sources import files as fs
from citemill.sources.store import ChunkStore
from citemill.streaming.poll import start_polling

VALID = """valid AS (
  SELECT *, list_extract(string_split(absolute_path, '/'), -1) AS file_name FROM files
  WHERE NOT starts_with(list_extract(string_split(absolute_path, '/'), -1), '.')
    AND length > 0 AND ends_with(lower(absolute_path), '.pdf'))"""

CHANGED = """changed AS (
  SELECT v.absolute_path, v.length, v.modified_ms
  FROM valid v LEFT JOIN manifest m USING (absolute_path)
  WHERE m.modified_ms IS NULL OR m.modified_ms < v.modified_ms)"""


def _valid(spark, folder):
    listing = given.files(spark, folder)
    return listing.filter(fs.is_valid_pdf(F.col("absolute_path"), F.col("length")))


def _table_rows(spark, folder):
    """File name and row count of every given table."""
    counts = [
        given.table(spark, folder, name).agg(F.count("*").alias("n_rows")).withColumn("file_name", F.lit(f"{name}.parquet"))
        for name in TABLES
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TABLE_ROWS = " UNION ALL ".join(f"SELECT '{name}.parquet' AS file_name, count(*) AS n_rows FROM {name}" for name in TABLES)


@register("s1_scan_all", f"SELECT file_name, true AS has_bytes, n_rows FROM ({TABLE_ROWS})")
def s1(spark, folder):
    """The listing of the given folder itself, with the rows that each file turns out to hold."""
    prepare_session(spark)
    listing = fs.list_folder(spark, folder, "*.parquet").select(
        fs.base_name(F.col("absolute_path")).alias("file_name"), (F.col("length") > 0).alias("has_bytes")
    )
    return listing.join(_table_rows(spark, folder), "file_name")


@register(
    "s2_scan_directory",
    f"SELECT file_name, '/' || file_name AS path_end, true AS has_size, n_rows FROM ({TABLE_ROWS}) WHERE file_name LIKE '%s.parquet'",
)
def s2(spark, folder):
    """Payloads of the files of a given folder that a pattern names."""
    prepare_session(spark)
    payloads = fs.scan_folder(spark, folder, "*s.parquet", suffix=".parquet")
    return payloads.join(_table_rows(spark, folder), "file_name").select(
        "file_name",
        F.regexp_extract("absolute_path", "/[^/]*$", 0).alias("path_end"),
        ((F.col("file_size_kb") >= 1) & F.col("last_modified").isNotNull()).alias("has_size"),
        "n_rows",
    )


@register(
    "s3_valid_pdf",
    given.with_ctes("SELECT file_name, length FROM valid", given.FILES, VALID),
)
def s3(spark, folder):
    return _valid(spark, folder).select(fs.base_name(F.col("absolute_path")).alias("file_name"), "length")


@register("s4_file_payload", given.with_ctes("SELECT * FROM payloads", given.FILES, given.PAYLOADS))
def s4(spark, folder):
    return fs.file_payloads(given.files(spark, folder))


@register(
    "s5_scan_for_changes",
    given.with_ctes("SELECT * FROM changed", given.FILES, VALID, given.MANIFEST, CHANGED),
)
def s5(spark, folder):
    changed = fs.changed_files(_valid(spark, folder), given.manifest(spark, folder))
    return changed.select("absolute_path", "length", "modified_ms")


@register(
    "j1_delta_lookup",
    given.with_ctes(
        """SELECT v.absolute_path, m.modified_ms AS prior_ms, v.modified_ms
           FROM valid v LEFT JOIN manifest m USING (absolute_path)""",
        given.FILES, VALID, given.MANIFEST,
    ),
)
def j1(spark, folder):
    prior = given.manifest(spark, folder).withColumnRenamed("modified_ms", "prior_ms")
    return _valid(spark, folder).join(prior, "absolute_path", "left").select(
        "absolute_path", "prior_ms", "modified_ms"
    )


@register(
    "s6_manifest_update",
    given.with_ctes(
        """SELECT absolute_path, modified_ms FROM manifest
           WHERE absolute_path NOT IN (SELECT absolute_path FROM changed)
           UNION ALL SELECT absolute_path, modified_ms FROM changed""",
        given.FILES, VALID, given.MANIFEST, CHANGED,
    ),
)
def s6(spark, folder):
    known = given.manifest(spark, folder)
    return fs.updated_manifest(known, fs.changed_files(_valid(spark, folder), known))


@register(
    "s7_payload_json",
    given.with_ctes(
        """SELECT file_name, absolute_path, CASE WHEN file_size_kb = 1 THEN 0 ELSE file_size_kb END AS file_size_kb,
                  date_trunc('second', last_modified) AS last_modified
           FROM payloads""",
        given.FILES, given.PAYLOADS,
    ),
)
def s7(spark, folder):
    """Bodies without a name, and without a size for the smallest files, read back."""
    payloads = fs.file_payloads(given.files(spark, folder)).withColumns(
        {
            "file_name": F.lit(None).cast("string"),
            "file_size_kb": F.when(F.col("file_size_kb") > 1, F.col("file_size_kb")),
        }
    )
    return fs.payload_from_json(fs.payload_to_json(payloads))


@register(
    "s8_missing_source",
    given.with_ctes(
        "SELECT * FROM payloads WHERE absolute_path NOT IN (SELECT absolute_path FROM manifest)",
        given.FILES, given.PAYLOADS, given.MANIFEST,
    ),
)
def s8(spark, folder):
    return fs.missing_sources(fs.file_payloads(given.files(spark, folder)), given.manifest(spark, folder))


@register(
    "d1_distinct_payloads",
    given.with_ctes(
        "SELECT DISTINCT * FROM (SELECT * FROM payloads UNION ALL SELECT p.* FROM payloads p JOIN manifest USING (absolute_path))",
        given.FILES, given.PAYLOADS, given.MANIFEST,
    ),
)
def d1(spark, folder):
    payloads = fs.file_payloads(given.files(spark, folder))
    again = payloads.join(given.manifest(spark, folder), "absolute_path", "left_semi").select(*payloads.columns)
    return fs.distinct_payloads(payloads.unionByName(again))


def _dispatched(spark, folder):
    """One dispatch per file, one scan per source; a labelled toxic file fails."""
    listing = given.files(spark, folder)
    labels = given.table(spark, folder, "labels").select("doc_id", "toxic")
    return listing.join(labels, "doc_id", "left").select(
        F.element_at(F.split("absolute_path", "/"), 3).alias("scan"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("ok"),
    )


DISPATCHED = """dispatched AS (
  SELECT string_split(absolute_path, '/')[3] AS scan, coalesce(toxic, 0) = 0 AS ok
  FROM files LEFT JOIN labels USING (doc_id)),
scans AS (SELECT scan, count(*) FILTER (ok) AS synchronized, count(*) AS dispatched FROM dispatched GROUP BY scan)"""


@register(
    "a4_dispatch_summary",
    given.with_ctes(
        """SELECT *, CAST(sum(synchronized) OVER (ORDER BY CAST(substr(scan, 4) AS INTEGER)) AS BIGINT) AS running_total
           FROM scans""",
        given.FILES, DISPATCHED,
    ),
)
def a4(spark, folder):
    scans = dispatch_summary(_dispatched(spark, folder), ["scan"]).withColumns(
        {"number": F.substring("scan", 4, 9).cast("int"), "log": F.lit("scans")}
    )
    running = running_values(scans, ["log"], "number", totals={"earlier": "synchronized"})
    return running.select(
        "scan", "synchronized", "dispatched", (F.col("earlier") + F.col("synchronized")).alias("running_total")
    )


@register(
    "p21_scan_status",
    given.with_ctes(
        """SELECT scan,
             CASE WHEN scan IN ('src1', 'src2') THEN 'Scan deferred: Python AI engine is currently unreachable.'
                  WHEN synchronized = dispatched THEN 'Scan completed: Knowledge base is up to date (no new/modified PDFs).'
                  ELSE 'Scan completed successfully: ' || synchronized || '/' || (dispatched) || ' documents synchronized.' END AS scheduled,
             CASE WHEN scan IN ('src1', 'src2') THEN 'Manual scan aborted: Python AI engine is offline.'
                  ELSE 'Manual scan completed: ' || synchronized || '/' || dispatched || ' documents dispatched.' END AS manual
           FROM scans""",
        given.FILES, DISPATCHED,
    ),
)
def p21(spark, folder):
    """Scans without a failure stand in for those that found nothing to do."""
    scans = dispatch_summary(_dispatched(spark, folder), ["scan"])
    healthy = ~F.col("scan").isin("src1", "src2")
    found = F.when(F.col("synchronized") == F.col("dispatched"), 0).otherwise(F.col("dispatched"))
    return scans.select(
        "scan",
        scan_status(F.lit(False), healthy, F.col("synchronized"), found).alias("scheduled"),
        scan_status(F.lit(True), healthy, F.col("synchronized"), F.col("dispatched")).alias("manual"),
    )


@register(
    "st2_manual_trigger",
    given.with_ctes(
        """SELECT * FROM (WITH with_pages AS (SELECT DISTINCT document_name FROM solid_pages),
        scans AS (
          SELECT 'changed' AS scan, count(*) AS a, count(document_name) AS b
          FROM changed LEFT JOIN with_pages ON document_name = list_extract(string_split(absolute_path, '/'), -1)
          UNION ALL
          SELECT 'forced', count(*), count(document_name)
          FROM valid LEFT JOIN with_pages ON document_name = file_name)
        SELECT scan, a AS files_dispatched, 'Manual scan completed: ' || b || '/' || a || ' documents dispatched.' AS status FROM scans
        UNION ALL SELECT 'deferred', 0, 'Scan deferred: Python AI engine is currently unreachable.'
        UNION ALL SELECT 'aborted', 0, 'Manual scan aborted: Python AI engine is offline.'
        UNION ALL SELECT 'repeated', a - b, CASE WHEN a = b THEN 'Scan completed: Knowledge base is up to date (no new/modified PDFs).'
          ELSE 'Scan completed successfully: 0/' || (a - b) || ' documents synchronized.' END FROM scans WHERE scan = 'changed')""",
        given.FILES, VALID, given.MANIFEST, CHANGED, given.SOLID_PAGES,
    ).replace("'.PDF' ELSE", "'.pdf' ELSE"),
)
def st2(spark, folder):
    """Scans of one store through the job: deferred, aborted, changed files, the same again, and all files by force."""
    lower = F.regexp_replace("absolute_path", "PDF$", "pdf").alias("absolute_path")
    listing = given.files(spark, folder).select(lower, "length", "modified_ms")
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.write_manifest(given.manifest(spark, folder).select(lower, "modified_ms"))

    def read_pages(chosen):
        return given.solid_pages(spark, folder, chosen.select(fs.base_name(F.col("absolute_path")).alias("document_name")))

    scans = {
        "deferred": {"healthy": lambda: False},
        "aborted": {"healthy": lambda: False, "manual": True},
        "changed": {"manual": True},
        "repeated": {},
        "forced": {"manual": True, "force_all": True},
    }
    rows = []
    for name, options in scans.items():
        outcome = scan_and_ingest(store, listing, read_pages, **options)
        rows.append((name, outcome.dispatched, outcome.status))
    return spark.createDataFrame(rows, "scan string, files_dispatched bigint, status string")


@register(
    "st1_poll_ingest",
    given.with_ctes(
        """SELECT document_name, chunk_count, CAST(coalesce(1 - was, 1) AS BIGINT) AS version FROM (
             SELECT document_name, count(*) AS chunk_count FROM solid_chunks GROUP BY 1) c
           JOIN (SELECT v.file_name AS document_name,
                        CASE WHEN m.modified_ms >= v.modified_ms THEN 1 END AS was
                 FROM valid v LEFT JOIN manifest m USING (absolute_path)) USING (document_name)""",
        given.FILES, VALID, given.MANIFEST, given.SOLID_PAGES, given.SOLID_CHUNKS,
    ).replace("'.PDF' ELSE", "'.pdf' ELSE"),
)
def st1(spark, folder):
    """Two polling ticks: the labelled files as the manifest has them, then every file.

    Files the first tick saw with an older time are taken again by the second.
    """
    listing = given.files(spark, folder).withColumn(
        "absolute_path", F.regexp_replace("absolute_path", "PDF$", "pdf")
    )
    seen = given.table(spark, folder, "labels")
    first = listing.join(seen, "doc_id").withColumn(
        "modified_ms",
        F.col("modified_ms")
        + F.when(F.col("toxic") == 1, 60000).when(F.col("quality") == 0, -60000).otherwise(0),
    )
    store = ChunkStore(spark, scratch_path(spark, "store"))

    def read_pages(chosen):
        return given.solid_pages(spark, folder, chosen.select(fs.base_name(F.col("absolute_path")).alias("document_name")))

    progress = scratch_path(spark, "progress")
    for tick in (first, listing):
        rows = tick.select("absolute_path", "length", "modified_ms")
        start_polling(
            store, lambda rows=rows: rows, read_pages, progress, trigger={"availableNow": True}
        ).awaitTermination()
    return store.read().groupBy("document_name").agg(
        F.count("*").alias("chunk_count"), F.max("version").alias("version")
    )
