import pytest
from pyspark.sql import functions as F

from brindle.llm import split
from brindle.llm.split import pieces


@pytest.mark.parametrize("width", [120, 260, 400, 480])
def test_the_line_before_is_repeated_if_it_leaves_room(width):
    text = "\n".join(f"{i:04d} " + "word " * ((width - 5) // 5) for i in range(12))
    starts = {0, *(i + 1 for i, c in enumerate(text) if c == "\n")}
    cut = pieces(text, 500, 1)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for (a, b, _), (c, d, repeated) in zip(cut, cut[1:], strict=False):
        assert c <= b < d and len(text[c:d].removesuffix("\n")) <= 500
        line = text.rfind("\n", 0, b - 1) + 1
        if line > a or b in starts and b - line < 500:
            assert c <= line and repeated == 1


def test_one_long_line():
    text = "word " * 1000
    cut = pieces(text, 500, 1)
    assert cut[-1][1] == len(text) and all(b - a <= 500 for a, b, _ in cut)


def test_rows(spark):
    """Null, empty and clashing columns, repeated rows, ranges beyond the file, kinds without a limit."""
    long = "\n".join(f"line {i} of the ledger" for i in range(30))
    files = spark.createDataFrame([("p", "a", long, 2), ("p", "a", "old", 1), ("p", "b", None, 1), ("p", "c", "", 1), (None, "a", long, 1)], "project string, path string, text string, at int").select("*", F.timestamp_seconds("at").alias("ingested_at"), F.lit("x").alias("kind"))
    rows = [(1, "p", "a", 1, 99, "Method"), (1, "p", "a", 1, 99, "Method"), (2, "p", "a", 1, 2, "Method"), (3, "p", "a", 1, 30, None), (4, "p", "a", 1, 30, "Unheard"), (5, "p", "b", 1, 30, "Method"), (6, "p", "c", 1, 30, "Method"), (7, "p", "none", 1, 30, "Method"), (8, "p", "a", None, None, "Method"), (9, None, "a", 1, 30, "Method"), (10, "p", "a", 0, 30, "Class")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, project string, path string, start_line int, end_line int, kind string").withColumns({"text": F.lit("clash"), "max_chars": F.lit(1)})
    limits = spark.createDataFrame([("Method", 100, 1), ("Unknown", 200, 0), ("Class", 10_000, 1), ("Class", 10_000, 1)], "kind string, max_chars int, overlap_lines int")
    assert sorted(r.chunk_id for r in split.found(chunks, files, limits).collect()) == [1, 3, 4]
    got = [r for r in split.split_chunks(chunks, files, limits).orderBy("chunk_id", "piece").collect() if r.chunk_id == 1]
    assert got[0].start_line == 1 and got[-1].end_line == 30 and all(r.n_chars == len(r.text) <= 100 for r in got) and all(r.overlap_lines == 1 for r in got[1:])
    for empty in ((chunks.limit(0), files, limits), (chunks, files.limit(0), limits), (chunks, files, limits.limit(0))):
        assert split.found(*empty).isEmpty()


def test_an_edit_changes_neighbours_only():
    text = "\n".join(f"entry {i * 7919 % 1000} of berth {i} holds {i * i % 97} crates" for i in range(400))
    at = text.index("berth 200")
    edited = text[:at] + "the new " + text[at:]
    a, b = ({t[x:y] for x, y, _ in pieces(t, 800, 0)} for t in (text, edited))
    assert len(b) > 20 and len(b - a) <= 4
