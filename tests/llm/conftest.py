import pytest

LONG = "lorem ipsum dolor sit amet " * 8000
ODD = [(1, None, "x"), (2, "", "x"), (3, LONG, "y"), (4, "one two three four five six seven", "y"),
       (4, "one two three four five six seven", "y"), (None, "one two three four five six seven", None), (5, " \t\n", "z"), (6, "Ünïcode ß 𝄞", "z")]


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null and empty and long texts, repeated rows, a null id, and columns named like inner ones."""
    names = ["source", "token", "hashes", "s", "rank", "score", "text_hash", "_part", "_row", "n", "word", "key", "part", "file", "salt", "digest",
             "_hit", "_gone", "_rank", "_text_id", "id", "response"]
    rows = [(*r, *range(len(names) - 1)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names[1:]))
