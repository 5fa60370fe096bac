import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, spans string, id long, key long, component_id long, score double, found string, n int, rep long, ids int, media string, epoch int, place int"


def edge_rows():
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (7, long_text), (8, "x" * 50_000), (5, "one two three four five six"), (9, "naïve ſecret é中😀 <|endoftext|> \x85\x1c")]
    return [(i, t, None if i == 4 else "en", None if i == 2 else "src0", None if t is None else len(t), "s", 1, 2, 3, 0.5, "f", 1, 4, 5, "m", 6, 7) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), CLASH)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
