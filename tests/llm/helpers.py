"""Small tables for the operators' tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts: list[str | None], first: int = 0, langs: list[str | None] | None = None) -> DataFrame:
    rows = [(first + i, t, (langs[i] if langs else "en"), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
