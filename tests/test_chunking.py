import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.operators.chunking import chunk_pages, split_chunks, split_text

SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")


def queue_split(text, size, overlap, separators=SEPARATORS):
    """The splitting contract, piece by piece."""
    level = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, rest = separators[level], separators[level + 1:]
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0], *(separator + p for p in parts[1:])] if p]
    else:
        pieces = list(text)
    chunks, queue = [], []

    def merge():
        current = []
        for piece in queue:
            if current and len("".join(current)) + len(piece) > size:
                chunks.append("".join(current).strip())
                while current and (
                    len("".join(current)) > overlap or len("".join(current)) + len(piece) > size
                ):
                    current.pop(0)
            current.append(piece)
        chunks.append("".join(current).strip())
        queue.clear()

    for piece in pieces:
        if len(piece) < size:
            queue.append(piece)
        else:
            merge()
            chunks.extend(queue_split(piece, size, overlap, rest) if rest else [piece])
    merge()
    return [chunk for chunk in chunks if chunk]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "bb", "ccc", "é", " ", "\n", "\n\n", ". ", "; ", ".", "dddddddddddd"]), max_size=60),
    st.integers(4, 24),
    st.integers(0, 3),
)
def test_split_follows_contract(parts, size, overlap):
    text = "".join(parts)
    chunks = split_text(text, size, overlap)
    assert chunks == queue_split(text, size, overlap)
    assert all(len(chunk) <= size and chunk in text for chunk in chunks)


@pytest.mark.parametrize("length", [1, 999, 1000, 1001, 1800, 1801, 2600, 2601, 5000])
def test_closed_form_without_separators(length):
    text = "".join(chr(97 + i % 26) for i in range(length))
    count = 1 if length <= 1000 else 1 + -(-(length - 1000) // 800)
    assert split_text(text) == [text[800 * i:800 * i + 1000] for i in range(count)]


def test_split_column_takes_null_and_empty(apply):
    assert apply(split_chunks, [None, "", " \n", "one"]) == [[], [], [], ["one"]]


def test_numbering_and_sections_across_blocks(spark):
    """Sections and numbers carry over empty pages and block borders."""
    texts = ["Revision Date Approved by: x", "SECTION 1\nalpha", "beta", "", "x" * 1900, "SECTION 2", "tail"]
    pages = spark.createDataFrame(
        [("d.pdf", "/d.pdf", i + 1, len(texts), t) for i, t in enumerate(texts)] + [("e.pdf", "/e.pdf", 1, 1, "only")],
        "document_name string, file_path string, page int, total_pages int, raw_text string",
    )
    for block_rows in (1, 2, 3, 1024):
        rows = chunk_pages(pages, block_rows=block_rows).filter("document_name = 'd.pdf'").orderBy("chunk_index").collect()
        assert [(r.page, r.index_in_page, r.chunk_index, r.section) for r in rows] == [
            (2, 0, 0, "SECTION 1"), (3, 0, 1, "SECTION 1"), (5, 0, 2, "SECTION 1"), (5, 1, 3, "SECTION 1"),
            (5, 2, 4, "SECTION 1"), (6, 0, 5, "SECTION 2"), (7, 0, 6, "SECTION 2"),
        ]
        assert rows[0].chunk_id == f"d.pdf_p2_c0_{rows[0].chunk_hash}"
    first = chunk_pages(pages).filter("document_name = 'e.pdf'").first()
    assert first.section == "General Overview"


def test_one_document_with_a_third_of_all_pages(spark):
    """Blocks of a huge document spread, and give what one window gives."""
    from pyspark.sql import Window

    from citemill.operators.running import running_values

    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").alias("page"),
        F.when(F.col("id") % 7 == 0, F.col("id").cast("string")).alias("h"),
        (F.col("id") % 5).alias("n"),
    )
    got = running_values(rows, ["k"], "page", last={"seen": "h"}, totals={"before": "n"}, block_rows=64)
    w = Window.partitionBy("k").orderBy("page")
    want = rows.withColumn("seen", F.last("h", True).over(w)).withColumn(
        "before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
