import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean, row long, fp long, score double, keep_id long, rows int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators use inside."""

    def docs(rows, parts=3):
        out = spark.createDataFrame([(i, t, "en", None, None, "x", True, 7, 8, 0.5, 9, 1) for i, t in rows], SCHEMA)
        return out.repartition(parts) if rows else out

    return docs


WORDS = "the river runs over old stones while two birds call from a tall tree near our small white house by the lake".split()


@pytest.fixture(scope="session")
def odd():
    """Nulls, blanks, repeated rows, ties, a null id and a very long text."""
    long = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 997) for i in range(30_000))
    prose = " ".join(WORDS) + "."
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose), (4, prose), (5, prose.upper()), (6, prose + " Ünïcode ĲÉ"), (None, prose), (None, None), (7, long), (8, "a"), (9, "x" * 70_000)]
