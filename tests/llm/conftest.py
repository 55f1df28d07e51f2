import pytest



@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    prose = "The river bends north of the old town, and the road follows it. Boats carry grain there in spring. Nobody has counted them since the war ended, they say.\n"
    texts = [
        (1, prose * 3 + "One more sentence stands here alone."),
        (1, prose * 3 + "One more sentence stands here alone."),  # a repeated row
        (2, prose * 3 + "One more sentence stands here alone."),  # a copy
        (3, None),
        (4, ""),
        (5, " \t\n \n"),
        (6, "word"),
        (7, "two words"),
        (8, "a " * 40_000),
        (9, "x" * 70_000),
        (10, "".join(f"Term{i} follows term{i * 7 % 5003} closely. " for i in range(9000))),
        (11, "É" * 300 + " ß ñ 漢字 \U0001f600   end"),
        (12, "Released under the MIT License.\nHome | About | Contact\n### $$$ %%%"),
        (None, "A row without an id has a text as well."),
        (None, None),
        (-5, "Negative ids are ids."),
        (-5, "Another text of the same id, quite unlike the first one."),
    ]
    rows = [(i, t, *(["x"] * 8), "de", 7, "s", "y", "z") for i, t in texts]
    return spark.createDataFrame([(r[0], r[1], *r[2:10], r[10], r[11], r[12], r[13], r[14]) for r in rows], "doc_id long, text string, words string, lines string, sig string, component_id string, bucket string, part string, n string, row string, lang string, n_chars long, source string, toxic string, `odd name` string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
