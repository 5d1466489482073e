import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) rows -> a DataFrame shaped like documents, over several partitions, with a column that clashes."""

    def make(rows, parts=3):
        full = [(i, t, None if t is None else "en", "src0", None if t is None else len(t), "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
