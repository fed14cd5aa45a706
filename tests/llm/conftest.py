import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(LOWER)


PASSAGE = " ".join(f"w{i}" for i in range(40))
#: nulls, empty, blank, very long, ties, repeated rows, repeated ids with other texts
EDGE = [
    (1, "a b c", "x"), (1, "a b c", "x"), (1, "other text of the same id", None), (2, None, "y"), (3, "", "y"), (4, " \n\t ", None), (5, PASSAGE, "z"),
    (6, "before " + PASSAGE + " after", "z"), (7, "Aé中 b\n\nc\n\n" * 30, "z"), (8, "long " * 30000, None), (None, PASSAGE, "n"), (None, None, None), (9, "a  b\tc", "tie"), (10, "<|endoftext|> a", "t"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge cases, with extra columns whose names operators use inside."""
    rows = [(i, t, s, 7, 7, "k", 1.0, "q") for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, batch int, id string, fp double, component_id string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
