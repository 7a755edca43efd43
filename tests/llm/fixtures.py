"""Small document tables with odd rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row_key string, h string, rank int"

LONG = " ".join(f"word{i}" for i in range(3000))
PROSE = "the quick brown fox jumps over the lazy dog and runs to the old barn near a river in the far green hills of home"


def documents(spark, texts=None):
    """Odd and plain texts: null, empty, blank, long, equal, nearly equal, one id twice; clashing column names."""
    texts = texts or [
        (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE.replace("quick", "swift"), "b"), (4, None, "b"), (5, "", None), (6, " \t\n", None),
        (7, LONG, "a"), (8, "one", "é"), (9, "One two\nOne two\n\nthree éa ÉA 'x' # $", "b"), (10, LONG + " tail", "\U0001f600"),
        (11, "a b c d e " * 40, "a"), (11, "a b c d e " * 40, "a"), (12, PROSE.upper(), None), (None, PROSE + " end", "b"),
    ]
    rows = [(i, t, "en", s, len(t or ""), "clash", "clash", 0) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole(spark, sf_dir):
    """The table of the test data as (doc_id, text, source) tuples."""
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
