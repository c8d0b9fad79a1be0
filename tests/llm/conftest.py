import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents frame of (id, text[, lang]) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that the operators use inside
            for c in ("name", "n", "score", "kept", "rep", "regs", "lo", "hi", "own", "at", "held_out", "digest", "lows", "s"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("clash"))
        return df

    return make
