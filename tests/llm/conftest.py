import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of given texts, with a null id and text, a repeated row, and columns named like the operators' own."""

    def make(texts, source="s", extra=False):
        rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("k1", "k2", "rid", "spans", "score", "host", "path", "row", "bucket", "item", "start", "ids", "label", "rule"):
                df = df.withColumn(name, F.lit(f"own {name}"))
        return df

    return make
