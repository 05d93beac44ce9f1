import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
COPY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    (1, COPY, "en", "a"), (2, COPY, "en", "a"), (2, COPY, "en", "a"), (3, COPY + " one", "en", "b"), (4, None, None, None), (5, "", "en", "b"),
    (6, "  \n\t ", "fr", "a"), (None, COPY, "en", "a"), (7, LONG, "de", "c"), (8, "ein zwei", "de", None), (9, "Été 中文 🎉 ² ½ naïve Σίσυφος", None, "c"),
    (10, "x " * 300, "en", "a"), (11, "end <|endoftext|> of it", "en", "a"), (12, "A\x1fB\x85C D", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, lang, source, len(t) if t else None, "k", 1, 2.0, True) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, score double, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
