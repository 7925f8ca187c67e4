import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with null columns besides."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
        if extra:  # names that operators use themselves
            for c in ("kept", "node", "label", "key", "part", "shard", "size", "digest", "score", "bands", "verdict", "sequence_id"):
                df = df.withColumn(c, df["doc_id"].cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (6, long), (6, long), (None, "no id here at all"), (7, "a\x00b\x1cc é ß 日本"), (8, "one"), (9, None)]
