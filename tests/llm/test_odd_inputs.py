"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, no rows."""

import pytest

import corpus_pipeline
from citemill.llm import (
    concat_cut,
    extendible_dedup,
    host_paths,
    language_mixture,
    line_index,
    markov_secrets,
    piece_agenda,
    rule_ledger,
    simhash_balls,
)

PER_ROW = {
    "rules": lambda d: rule_ledger.apply_policy(rule_ledger.ledger(d)),
    "lines": line_index.dedup_lines,
    "secrets": lambda d: markov_secrets.scan(d, markov_secrets.train(d)),
    "language": lambda d: language_mixture.identify(d, *language_mixture.trained_on(d)),
    "exact": extendible_dedup.exact_groups,
    "pieces": lambda d: piece_agenda.encode_decode(d, piece_agenda.model_bytes(), check_texts=True),
    "near": simhash_balls.near_groups,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_result_per_row(odd_docs, no_docs, name):
    found = [r.doc_id for r in PER_ROW[name](odd_docs).collect()]
    expected = [r.doc_id for r in odd_docs.select("doc_id").collect()]
    key = lambda x: (x is None, x or 0)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert PER_ROW[name](no_docs).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, odd_docs, no_docs, name, stage):
    assert stage(spark, odd_docs, "").schema.names == odd_docs.columns
    assert stage(spark, no_docs, "").count() == 0


def test_stages_decide(spark, odd_docs):
    language, exact, near, secrets = (s for _, s in corpus_pipeline.STAGES[:-1])
    kept = {r.doc_id for r in language(spark, odd_docs, "").collect()}
    assert not kept & {0, 1, 2, 11, 13} and {3, 4, 5, 8, 9, 10, 12} <= kept
    kept = {r.doc_id for r in exact(spark, odd_docs, "").collect()}
    assert 6 in kept and not kept & {4, 5, None} and {1, 3, 7, 8} <= kept
    # Equal texts leave one row, whatever their ids.
    assert exact(spark, odd_docs, "").where("text is null or text = ''").count() == 1
    kept = [r.doc_id for r in near(spark, odd_docs, "").collect()]
    assert 4 in kept and not {5, 6} & set(kept)
    texts = {r.doc_id: r.text for r in secrets(spark, odd_docs, "").where("doc_id in (8, 10)").collect()}
    assert texts[10] == 'config: [secret]" and [secret] end' and texts[8].startswith("Été")


def test_verdicts_are_on_rows(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon"),
        (1, "one two three four five six seven"),
        (2, "one two three four five six seven"),
        (3, None),
        (3, "wort und noch ein wort dazu"),
        (5, "the same text on two equal rows"),
        (5, "the same text on two equal rows"),
        (None, "a text that has no id at all"),
        (None, "a text that has no id at all"),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3)
    language, exact, near, secrets = (s for _, s in corpus_pipeline.STAGES[:-1])

    def left(frame):
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    assert left(language(spark, docs, "")) == sorted((r for r in rows if r[1]), key=str)
    once = sorted([rows[0], rows[2], rows[3], rows[4], rows[5], rows[7]], key=str)
    assert left(exact(spark, docs, "")) == once
    assert left(near(spark, docs, "")) == sorted([rows[0], rows[1], rows[3], rows[4], rows[5], rows[7]], key=str)
    for stage in (language, secrets):
        plan = stage(spark, docs.limit(0).unionByName(spark.createDataFrame([], docs.schema)), "")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_packing_covers_every_row(spark, odd_docs, no_docs):
    pieces = corpus_pipeline.packing(spark, odd_docs, "").collect()
    assert sum(p.length for p in pieces if p.doc_id == 0) == 1
    assert sum(p.length for p in pieces if p.start == 0 or p.start > 0) == max(
        p.sequence_id * 2048 + p.offset + p.length for p in pieces
    )
    assert len({(p.doc_id, p.sequence_id, p.offset) for p in pieces if p.start == 0}) == odd_docs.count()
    assert corpus_pipeline.packing(spark, no_docs, "").count() == 0


def test_pages(spark, no_docs):
    pages = spark.createDataFrame(
        [(1, None, None, 1), (2, "nonsense", "", 1), (3, "http://a.b/", "<p>Only <b>this</b>", 1), (3, "http://a.b/", "<p>Only <b>this</b>", 1), (None, None, "x" * 300_000, 1)],
        "page_id long, url string, html string, path int",
    )
    found = {(r.page_id, r.text[:10]) for r in host_paths.extract_main_texts(pages).collect()}
    assert found == {(1, ""), (2, ""), (3, "Only this"), (None, "x" * 10)}
    assert host_paths.extract_main_texts(pages.limit(0)).count() == 0


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 0 < rows.select("doc_id").distinct().count() < 200
