"""What the library adds to SQL.

    register_sql_functions(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL split_chunks(d.text) c

``split_chunks(text [, size [, overlap]])`` is a table function: the chunks of a text in
order, as (index_in_page, text). Rows reach Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from citemill.functions import fixed_values as fixed
from citemill.operators.chunking import split_text


class SplitChunks:
    """Rows of one text's chunks; null has none. Arguments left out have the library's defaults."""

    def eval(self, text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
        if size is None or overlap is None or not 0 <= overlap < size:
            raise ValueError("a chunk's overlap must be at least 0 and less than its size")
        if text is not None:
            yield from enumerate(split_text(text, size, overlap))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``split_chunks`` callable from the session's SQL."""
    spark.udtf.register("split_chunks", udtf(SplitChunks, returnType="index_in_page int, text string", useArrow=True))
