"""What an ingest spends goes by the documents it takes in, evenly over the tasks."""

import random
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citemill.functions import fixed_values as fixed
from citemill.functions import text as tx
from citemill.operators.chunking import clean_pages, number_chunks, split_pages, split_text
from citemill.plans import ingest
from citemill.registry import inputs as given
from citemill.sources.store import ChunkStore

PAGES = "document_name string, file_path string, page int, total_pages int, raw_text string"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def pages(spark, documents, count=1):
    return spark.createDataFrame(
        [(f"d{d}", "/d", p + 1, count, f"SECTION {d}\nbody {p}" if p % 3 == 0 else f"body {p}") for d in range(documents) for p in range(count)],
        PAGES,
    )


def test_documents_are_chosen_before_their_pages_are_made(spark, tmp_path):
    texts = [(i, "src1", f"text {i} " * 700) for i in (1, 1, 2, 3, None)]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = spark.createDataFrame([("doc_1.pdf",), ("doc_3.pdf",), ("doc_3.pdf",), (None,), ("doc_9.pdf",)], "document_name string")
    every, some = given.solid_pages(spark, str(tmp_path)), given.solid_pages(spark, str(tmp_path), names)
    assert some.columns == every.columns
    wanted = every.where("document_name IN ('doc_1.pdf', 'doc_3.pdf')")
    assert sorted(some.collect()) == sorted(wanted.collect()) and some.count() == 6
    # The plan is printed from the last step to the first.
    assert plan(some).index("Generate") < plan(some).index("LeftSemi")


def test_wide_rows_are_sorted_once(spark):
    steps = plan(number_chunks(split_pages(clean_pages(pages(spark, 3, 4), keep_empty=True))))
    wide = [line for line in steps.splitlines() if "Sort [" in line]
    # The window's sort serves the join; the other sorts are those of the slim table.
    assert steps.index("SortMergeJoin") < steps.index("Window [last(__header")
    assert "Sort [" not in steps[steps.index("SortMergeJoin"):steps.index("Window [last(__header")]
    assert len(wide) >= 1


def test_pages_are_dealt_to_as_many_tasks_as_asked_for(spark):
    split = split_pages(clean_pages(pages(spark, 20, 7), keep_empty=True))
    dealt = number_chunks(split, block_rows=3, tasks=5)
    assert dealt.rdd.getNumPartitions() == 5
    assert sorted(dealt.collect()) == sorted(number_chunks(split, block_rows=3).collect())


def test_an_ingest_writes_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PAGES_PER_TASK", 20, raising=False)
    store = ChunkStore(spark, str(tmp_path / "store"))
    ingest.ingest_pages(store, pages(spark, 200))
    assert len(list(Path(tmp_path, "store/chunks/version=0").glob("*.parquet"))) > 8
    assert store.read().count() == 200


def test_text_without_separators_is_not_gone_through_character_by_character():
    text = "x" * 2_000_000
    tracemalloc.start()
    chunks = split_text(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chunks == [text[at:at + 1000] for at in range(0, len(text) - 200, 800)]
    assert peak < 10_000_000


@pytest.mark.parametrize("size,overlap", [(2, 0), (2, 1), (7, 3), (10, 0), (10, 9), (10, 10)])
def test_solid_runs_are_cut_as_before(size, overlap):
    """A separator that every character is gives the pieces that single characters give."""
    for length in (1, 2, 6, 7, 8, 20, 43):
        text = "a" * length
        assert split_text(text, size, overlap, ("",)) == split_text(text, size, overlap, ("a", ""))


def test_pages_that_match_no_pattern_alone_are_cleaned_as_by_all_patterns(spark):
    parts = [
        "Revision Date Approved by:", "REVISION DATE APPROVED BY:", "revıſion date approved by: x", "Approved by:", "\n", "\n\n", "\r", " ",
        "Laboratory Safety Manual", "LABORATORY ſAFETY MANUAL", "labora", "tory safety manual", "Safety", "manual", "İKΣ", "text",
    ]
    dice = random.Random(3)
    texts = [None, ""] + ["".join(dice.choices(parts, k=dice.randint(1, 9))) for _ in range(1500)]
    texts.append("LaboraRevision Date Approved by: me\ntory Safety Manual text")
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.col("t")
    for pattern, instead in ((fixed.APPROVAL_LINE, ""), (fixed.MANUAL_TITLE, ""), (fixed.BLANK_LINE_RUN, "\n\n")):
        plain = F.regexp_replace(plain, pattern, instead)
    found = raw.select("t", tx.clean_page_text(F.col("t")).alias("found"), tx.strip(plain).alias("plain"))
    assert [r for r in found.collect() if r.found != r.plain] == []


def test_letters_of_the_clean_up_parts_have_no_third_form(spark):
    """So lower-casing finds whatever the patterns, which ignore case, would match."""
    letters = "".join(sorted(set((fixed.APPROVAL_PART + fixed.MANUAL_PART).replace(" ", ""))))
    others = spark.range(128, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")
    )
    assert others.where(F.col("c").rlike(f"(?iu)^[{letters}]$")).count() == 0
