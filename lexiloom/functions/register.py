"""The functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class _SplitText:
    def eval(self, text: str, size: int, overlap: int):
        from ..operators.chunking import chunks_of

        for i, (piece, start, end) in enumerate(chunks_of(text or "", size, overlap)):
            yield i, piece, start, end


def register(spark: SparkSession) -> None:
    """calc(expression), clean_ocr(text), query_coverage(query, passage), index_terms(text), parsed_step(completion), line_diff(before, after),
    and the table function split_text(text, size, overlap)."""
    from ..operators.insight import query_coverage
    from ..operators.retrieval import stemmed_terms
    from ..operators.review import line_diff
    from .calculator import calc, parsed_step
    from .ocr import clean_ocr_sql

    for name, f in {"calc": calc, "query_coverage": query_coverage, "index_terms": stemmed_terms, "parsed_step": parsed_step, "line_diff": line_diff}.items():
        spark.udf.register(name, f)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_ocr(raw STRING) RETURNS STRING RETURN {clean_ocr_sql('raw')}")
    spark.udtf.register("split_text", F.udtf(_SplitText, returnType="chunk_ix int, text string, start int, end int"))
