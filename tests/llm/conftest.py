import pytest

# Rows that every operator has to take: null and empty, white space, ties, repeated rows, null ids.
EDGE = [(None, "null id of some length here"), (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (3, "another text of the same id"),
        (4, "repeated row of text\nwith two lines"), (4, "repeated row of text\nwith two lines"), (5, "é世 ñ " * 40), (6, "x" * 5000)]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names clash with what operators use inside."""
    rows = [(d, t, "a", 1, 2, "z") for d, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, _d string, _r int, score int, line string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def vocabulary():
    from reviewlake.llm.queries import vocabulary
    return vocabulary()
