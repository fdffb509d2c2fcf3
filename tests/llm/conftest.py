import pytest


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns whose names clash with internal ones."""
    def make(rows):
        schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row int, id int, n int, key string, "
                  "h string, d int, v int, name string, fp int, line string, words string, keys string, h2 int")
        full = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "k", "h", 4, 5, "m", 6, "l", "w", "ks", 7) for i, t in rows]
        return spark.createDataFrame(full, schema)
    return make
