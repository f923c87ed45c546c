import pytest
from pyspark.sql import functions as F

from citemill.functions import answers as an
from citemill.functions import text as tx
from citemill.functions.fixed_values import WHITESPACE


def test_strip_knows_all_python_whitespace(apply):
    texts = [WHITESPACE + "a b" + WHITESPACE, WHITESPACE, "", "x"]
    assert apply(tx.strip, texts) == [t.strip() for t in texts]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("REVISION date Approved BY: me\nBody", "Body"),
        ("Body\nRevision Date Approved by: last line", "Body"),
        ("Revision Date Approved by: a\rb\nBody", "Body"),
        ("laboratory safety manual \n\n Body", "Body"),
        ("Laboratory Safety Manual Body", "Body"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n\nb", "a\n\nb"),
        (" \n  ", ""),
        ("", ""),
    ],
)
def test_clean_page_text(apply, raw, clean):
    assert apply(tx.clean_page_text, [raw]) == [clean]


@pytest.mark.parametrize(
    "page, header",
    [
        ("16.5 OTHER SITUATIONS\nprose", "16.5 OTHER SITUATIONS"),
        ("PAGE 4 OF 9\nAPPENDIX A: TRAINING\nprose", "APPENDIX A: TRAINING"),
        ("1. Foo", None),
        ("12 Ab", None),
        ("12 ABC", "12 ABC"),
        ("SECTION 3", "SECTION 3"),
        ("section 3", None),
        ("A B C", "A B C"),
        ("ABC", None),
        ("ABCD", "ABCD"),
        ("a\nb\n\nc\nd\ne\nSECTION 6", None),
        ("a\nb\n\n \nc\nd\nSECTION 5", "SECTION 5"),
        ("A" * 200, "A" * 90),
        ("", None),
        (" \n ", None),
        ("SHOUTED prose is a header", "SHOUTED prose is a header"),
    ],
)
def test_section_header(apply, page, header):
    assert apply(tx.found_header, [page]) == [header]
    assert apply(tx.section_header, [page]) == [header or "General Section"]


def test_embedding_text(apply):
    texts = ["\n\n", " \r\n ", "a\r\nb\nc ", "x", ""]
    assert apply(tx.embedding_text, texts) == ["empty", "empty", "a b c", "x", "empty"]


def test_snippet_lengths(apply):
    assert apply(tx.snippet, ["x" * 240, "x" * 241, " a \n b\t", ""]) == ["x" * 240, "x" * 240 + "...", "a b", ""]


@pytest.mark.parametrize(
    "answer, clean",
    [
        ("Text [1]\n## References\n- a", "Text <sup>[1]</sup>\n## References\n- a"),
        ("Text\n##References\n- a", "Text"),
        ("Text\n**References**\n- a", "Text"),
        ("Text\nreferences to y", "Text"),
        ("Text\nReferences: [1]\nmore\nReferences", "Text"),
        ("References first [2]", "References first <sup>[2]</sup>"),
        ("\nReferences: x", ""),
        ("Known <sup>[2]</sup>", "Known <sup><sup>[2]</sup></sup>"),
        (" [12] and [a] ", "<sup>[12]</sup> and [a]"),
    ],
)
def test_answer_cleanup(apply, answer, clean):
    assert apply(an.answer_cleanup, [answer]) == [clean]


def test_cache_key_ignores_case_and_outer_space(apply):
    keys = apply(lambda t: an.cache_key(t, F.lit(4)), ["  Wear GLOVES\n", "wear gloves", "wear  gloves"])
    assert keys[0] == keys[1] != keys[2]
    import hashlib

    assert keys[0] == hashlib.sha256(b"wear gloves_4").hexdigest()


def test_rejections(spark):
    rows = spark.createDataFrame(
        [(" ", 4), (None, 4), ("a", 0), ("a", 11), ("a", None), ("a", 10), ("a", 1)], "q string, k int"
    )
    found = rows.select(an.rejection_reason(F.col("q"), F.col("k"))).collect()
    assert [row[0] for row in found] == [
        "blank query", "blank query", "top_k out of range", "top_k out of range", None, None, None
    ]


def test_citation_label_leaves_out_empty_parts(spark):
    rows = spark.createDataFrame(
        [(1, "a.pdf", "S", 2), (2, None, None, None), (3, "b", "", 0)], "i int, d string, s string, p int"
    )
    label = an.citation_label(F.col("i"), F.col("d"), F.col("s"), F.col("p"))
    assert [r[0] for r in rows.select(label).collect()] == ["[1] a.pdf › S › Page 2", "[2] Document", "[3] b"]


def test_system_instruction_and_prompt(spark):
    row = spark.range(1).select(an.user_prompt(F.lit("ctx"), F.lit("why?")).alias("p")).first()
    assert row.p.startswith("REFERENCE CONTEXT:\nctx\nUSER QUESTION:\nwhy?\n\nProvide a structured")
