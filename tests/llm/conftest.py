import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, label string, score double, key bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "a"), (7, "a b"), (8, "A  B"), (9, "!!! ..."), (10, long_text), (11, long_text + " end"),
        (None, base), (None, None), (12, base.upper()), (13, "é ü ñ über façade"), (14, base.replace(" ", "\n")), (15, "x" * 70000), (16, base + " thirteen"),
    ]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None if i == 3 else "src1", 0, 7, "z", 0.5, 1) for i, t in rows], SCHEMA)
