"""Citations and context are collected apart."""

from citemill.operators.retrieval import cited_rows, collect_context


def cited(spark):
    rows = [(q, r, f"d{q}", r, "S", f"text {q} {r}", 0.1 * r) for q in range(3) for r in (3, 1, 2)]
    # The same place twice, as of chunks that come twice.
    rows += [(0, 2, "a", 1, "Z", "other", 0.2), (0, 2, "a", 9, "B", "another", 0.2)]
    kinds = "query_id int, rank int, document_name string, page int, section string, text string, distance double"
    return cited_rows(spark.createDataFrame(rows, kinds))


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_stay_out_where_only_citations_are_asked_for(spark):
    contexts = collect_context(cited(spark))
    assert "Excerpt" not in plan_of(contexts.select("query_id", "context_count", "citations"))
    assert "Excerpt" in plan_of(contexts.select("context"))


def test_both_are_in_the_same_order(spark):
    for row in collect_context(cited(spark)).collect():
        assert row.context_count == len(row.citations) == (5 if row.query_id == 0 else 3)
        assert [c["index"] for c in row.citations] == sorted(c["index"] for c in row.citations)
        named = [line.split("Document: ")[1] for line in row.context.split("\n") if "Document: " in line]
        assert named == [f"{c.document} | Section: {c.section} | Page: {c.page}" for c in row.citations]
