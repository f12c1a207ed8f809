"""The core's operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import vectors as V
from brindle.operators import chunking, index, lookup, overlay, search, snapshots
from brindle.sources import paths

LIST = "project string, path string, length int, mtime timestamp, content_hash string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("text, want", [(None, None), ("", []), ("\n", [""]), ("a", ["a"]), ("a\r\nb\rc\n", ["a", "b", "c"]), ("a\n\n", ["a", ""]), ("\r", [""])])
def test_lines(spark, text, want):
    assert one(spark, T.lines("x"), text) == want


@pytest.mark.parametrize("start, end, want", [(1, 2, "a\nb"), (0, 1, "a"), (-5, 9, "a\nb\nc"), (3, 3, "c"), (4, 9, ""), (2, 1, "")])
def test_line_range(spark, start, end, want):
    assert one(spark, T.line_range("x", F.lit(start), F.lit(end)), "a\r\nb\nc\n") == want


@pytest.mark.parametrize("text, units, want", [("abc", 2, "ab"), ("a😀b", 2, "a"), ("a😀b", 3, "a😀"), ("😀", 1, ""), ("", 5, ""), (None, 5, None), ("x" * 5000, 2000, "x" * 2000), ("abc", 0, "")])
def test_truncated(spark, text, units, want):
    assert one(spark, T.truncated("x", units), text) == want


def test_names(spark):
    assert [one(spark, T.leaf("x"), s) for s in ("A.B.c", "c", "a.", None)] == ["c", "c", "", None]
    assert [one(spark, T.directory("x"), s) for s in ("a/b/c.cs", "c.cs", "/c", None)] == ["a/b", "", "", None]
    assert one(spark, T.stripped("x"), " <a>b \n c</a><d\ne>f ") == "b c f"
    assert one(spark, T.content_hash("x"), "a\r\nb\n") == one(spark, T.content_hash("x"), "a\nb")


def test_paths(spark):
    files = spark.createDataFrame([("p", "a/B.CS"), ("p", "a/Bin/x.cs"), ("q", "a.cs"), ("r", "a.cs"), ("r", "a.razor"), ("p", None), ("z", "a.cs")], "project string, path string")
    projects = spark.createDataFrame([("p", [".cs"]), ("p", [".cs"]), ("q", []), ("r", None)], "project string, extensions array<string>")
    assert {tuple(r) for r in paths.indexed(files, projects).collect()} == {("p", "a/B.CS"), ("r", "a.cs"), ("r", "a.razor")}
    assert [one(spark, paths.normal_path("x"), s) for s in ("./a\\b", "././a", ".a", "a/./b")] == ["a/b", "a", ".a", "a/./b"]
    inner = spark.createDataFrame([("p", "sub/.git/HEAD"), ("p", "x/y/.git"), ("p", ".git/HEAD")], "project string, path string")
    tree = spark.createDataFrame([("p", "a.cs"), ("p", "sub/b.cs"), ("p", "x/c.cs"), ("p", "x/y/z/d.cs"), ("q", "sub/e.cs")], "project string, path string")
    assert {r.path for r in paths.outside_nested(tree, inner).collect()} == {"a.cs", "x/c.cs", "sub/e.cs"}


def windows(n, w, o):
    out, a = [], 1
    while n:
        out.append(a)
        if a + w - 1 >= n:
            break
        a += w - o
    return out


def test_window_starts(spark):
    for w, o in ((1, 0), (5, 2), (10, 9), (100, 20)):
        df = spark.range(0, 260).select("id", chunking.window_starts(F.col("id").cast("int"), w, o).alias("s"))
        assert all(list(r.s) == windows(r.id, w, o) for r in df.collect())
    for w, o in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.window_starts(F.lit(1), w, o)


def test_chunks_and_files(spark):
    files = spark.createDataFrame([("p", "a", "old", 1), ("p", "a", "l1\nl2\nl3", 2), ("p", "b", None, 1), (None, "c", "x", 1)], "project string, path string, text string, at int").select("*", F.timestamp_seconds("at").alias("ingested_at"), F.lit(1).alias("length"), F.lit(None).cast("timestamp").alias("mtime"))
    chunks = spark.createDataFrame([(1, "p", "a", 2, 9, None), (2, "p", "b", 1, 1, "Method"), (3, "p", "gone", 1, 1, "x")], "chunk_id int, project string, path string, start_line int, end_line int, kind string").withColumns({"body": F.lit("clash"), "symbol": F.lit(None).cast("string"), "signature": F.lit("s"), "doc": F.lit("")})
    assert {r.chunk_id: r.body for r in chunking.with_text(chunks, files).collect()} == {1: "l2\nl3", 2: None, 3: None}
    assert {r.chunk_id: r.excerpt for r in lookup.with_excerpt(chunks, files, 1).collect()} == {1: "l2", 2: "", 3: ""}
    assert {r.chunk_id: r.embed_text for r in chunking.with_embed_text(chunks, files).collect()}[1] == "File: a\nSymbol: \nKind: Unknown\nSignature: s\nCode:\nl2\nl3"
    assert chunking.line_windows(chunking.current_files(files)).count() == 1 and chunking.line_windows(files.limit(0)).isEmpty()


def listing(spark, rows):
    return spark.createDataFrame([("p", p, n, m, h) for p, n, m, h in rows], LIST.replace("timestamp", "int")).withColumn("mtime", F.timestamp_seconds("mtime"))


def test_diff_refresh_and_overlay(spark):
    old = listing(spark, [("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("gone", 1, 1, "h"), ("null", None, 1, None)])
    new = listing(spark, [("same", 1, 1, "x"), ("touched", 1, 2, "h"), ("edited", 2, 2, "i"), ("new", 1, 1, "h"), ("null", None, 1, None)])
    status = {r.path: r.status for r in index.fingerprint_diff(old, new).collect()}
    assert status == {"same": "unchanged", "touched": "touched", "edited": "changed", "gone": "deleted", "new": "added", "null": "changed"}
    assert index.any_changed(old, new).first().changed and not index.any_changed(old.filter("path <> 'null'"), old.filter("path <> 'null'")).first().changed
    assert {r.path: r.content_hash for r in index.refreshed_listing(old, new).collect()} == {"same": "h", "touched": "h", "edited": "i", "new": "h", "null": None}
    chunk = "project string, path string, n int"
    stored = spark.createDataFrame([("p", p, i) for p in ("same", "touched", "edited", "gone") for i in range(2)], chunk)
    fresh = spark.createDataFrame([("p", p, 9) for p in ("edited", "new", "same")], chunk)
    after = index.refreshed_chunks(stored, index.fingerprint_diff(old, new), fresh)
    assert sorted((r.path, r.n, r.reused) for r in after.collect()) == [("edited", 9, False), ("new", 9, False), ("same", 0, True), ("same", 1, True), ("touched", 0, True), ("touched", 1, True)]
    assert index.shape_changed(stored, after).first().changed and not index.shape_changed(stored, stored).first().changed
    diff = overlay.extract_diff(old, new)
    assert {(r.path, r.op) for r in diff.collect()} == {("same", "F"), ("edited", "F"), ("new", "F"), ("gone", "D")}
    columns = ["project", "path", "content_hash"]
    composed = overlay.compose(old.select(columns), diff.filter("op = 'F'").select(columns), diff.filter("op = 'D'"))
    assert sorted(map(repr, composed.collect())) == sorted(map(repr, new.select(columns).collect()))
    key = lambda d: overlay.content_key(d).first().content_key
    assert key(diff) == key(diff.orderBy(F.desc("path")).union(diff)) != key(diff.filter("path <> 'new'"))
    assert overlay.content_key(diff.limit(0)).isEmpty() and index.fingerprint_diff(old.limit(0), new.limit(0)).isEmpty()


def test_ordinals_and_slots(spark):
    c = spark.createDataFrame([("p", "b", 0), ("p", "a", 1), ("p", "a", 0), ("q", "z", 0)], "project string, path string, pos int")
    assert {(r.project, r.path, r.pos): r.ordinal for r in index.assign_ordinals(c, "pos").collect()} == {("p", "a", 0): 0, ("p", "a", 1): 1, ("p", "b", 0): 2, ("q", "z", 0): 0}
    s = spark.createDataFrame([("p", g, t) for g, t in ((1, 5), (2, 5), (3, None), (4, 9))], "project string, generation int, t int").withColumn("last_used", F.timestamp_seconds("t"))
    assert {r.generation for r in overlay.evicted(s, 2).collect()} == {1, 3}
    assert overlay.evicted(s, 9).isEmpty()
    with pytest.raises(ValueError):
        overlay.evicted(s, -1)


@pytest.mark.parametrize("text, want", [("a:b:3:42", ("a:b", 3, 42)), ("p:0:0", ("p", 0, 0)), ("p:1", None), (":1:2", None), ("p:-1:2", None), ("p:1:2147483648", None), ("p:1:2 ", None), ("p\nq:1:2", ("p\nq", 1, 2)), ("", None), (None, None)])
def test_ids(spark, text, want):
    got = one(spark, lookup.parsed_id("x"), text)
    assert (got and tuple(got)) == want


def test_lookup_and_stale(spark):
    chunks = spark.createDataFrame([(1, "p", "a", 1, 2), (1, "p", "a", 1, 2)], "chunk_id bigint, project string, path string, start_line int, end_line int")
    headers = spark.createDataFrame([("p", 3), ("p", 2)], "project string, generation int")
    ids = spark.createDataFrame([("p:3:1",), ("p:3:1",), ("p:2:99",), ("p:3:7",), ("q:1:1",), ("x",), (None,)], "id string")
    assert {r.id: r.status for r in lookup.lookup(ids, chunks, headers).collect()} == {"p:3:1": "found", "p:2:99": "stale", "p:3:7": "missing", "q:1:1": "unknown project", "x": "malformed", None: "malformed"}
    stat = listing(spark, [("a", 1, 1, None)])
    flag = lambda a, b: lookup.with_stale_flag(chunks.limit(1), a, b).first().stale
    other = listing(spark, [("a", 2, 1, None)])
    assert (flag(stat, stat), flag(stat, other), flag(stat.limit(0), stat), flag(stat, stat.limit(0)), flag(listing(spark, [("a", None, 1, None)]), listing(spark, [("a", None, 1, None)]))) == (False, True, True, True, True)


def test_l2(spark):
    row = lambda v: one(spark, V.l2_normalized("x", 2, strict=False), v, "array<float>")
    assert row([3.0, 4.0, 9.0]) == pytest.approx([0.6, 0.8]) and row([0.0, 0.0]) == [0.0, 0.0]
    assert row([1.0]) is None and row(None) is None and row([float("nan"), 1.0]) is None and row([float("inf"), 1.0]) is None
    with pytest.raises(Exception, match="normalised"):
        one(spark, V.l2_normalized("x", 2), [1.0], "array<float>")


def diversified(rows, limit, cap=2):
    seen, kept, later = {}, [], []
    for r in rows:
        free = r[1]
        if not free:
            seen[r[2]] = seen.get(r[2], 0) + 1
        (kept if free or seen[r[2]] <= cap else later).append(r)
    return sorted((kept + later)[:limit]) if limit > 0 else []


def test_diversify_like_the_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        n = rng.randrange(1, 25)
        rows = [(i + 1, rng.random() < 0.3, rng.choice("abc")) for i in range(n)]
        chunks = spark.createDataFrame([(r, "p", f) for r, _, f in rows], "chunk_id int, project string, path string")
        fused = spark.createDataFrame([(r, 1.0, e, r) for r, e, _ in rows], "chunk_id int, score double, exempt boolean, rank int")
        limit = rng.randrange(0, 12)
        assert sorted(r.rank for r in search.diversify(fused, chunks, limit).collect()) == [r[0] for r in diversified(rows, limit)]
    with pytest.raises(ValueError):
        search.diversify(fused, chunks, 5, 0)


def test_ties_and_fusion(spark):
    chunks = spark.createDataFrame([(i, "p", f"f{i}.cs", "Method", "S", "") for i in range(80)], "chunk_id bigint, project string, path string, kind string, symbol string, signature string")
    vectors = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(76)] + [(76, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [r.chunk_id for r in search.vector_branch(chunks, vectors, [1.0, 0.0], 5).collect()] == [76, 0, 1, 2, 3]
    assert search.vector_branch(chunks, vectors, [1.0, 0.0], 0).isEmpty()
    rank = "chunk_id bigint, rank int"
    a, b = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], rank), spark.createDataFrame([(30, 1), (40, 2)], rank)
    assert [r.chunk_id for r in search.fuse(a, b, 10).orderBy("rank").collect()] == [30, 10, 20, 40]
    for bad in ([], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            search.vector_branch(chunks, vectors, bad, 5)
    some = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, None), (9, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [(r.query_id, r.chunk_id) for r in search.vector_batch(vectors, some, 2, 2).orderBy("rank").collect()] == [(7, 76), (7, 0)]
    assert search.vector_batch(vectors, some.limit(0), 2, 2).isEmpty() and search.vector_batch(vectors.limit(0), some, 2, 2).isEmpty()


def test_snapshot_changes(spark):
    t = lambda s: F.timestamp_seconds(F.lit(s))
    rows = [("p", 1, "a", "H1", 1), ("p", 1, ".\\b", "h2", 1), ("p", 3, "a", "h1", 1), ("p", 3, "b", None, 1), ("p", 5, "./a", "h9", 2), ("p", 5, "a", "h1", 1), ("p", 5, "b", "h3", 1), ("p", 5, "c", "x", 1), ("p", 5, "c", "x", 1), ("p", 9, "z", "x", 1), (None, 1, "n", "x", 1), ("p", 3, None, "x", 1)]
    prints = spark.createDataFrame(rows, "project string, generation int, path string, content_hash string, at int").withColumns({"delivered_at": F.timestamp_seconds("at"), "place": F.lit(0), "k1": F.lit("clash")})
    headers = spark.createDataFrame([("p", g) for g in (1, 3, 5, 7, 7)], "project string, generation int").withColumn("built_at", t(0))
    got = sorted(map(tuple, snapshots.snapshot_changes(prints, headers).collect()))
    assert got == [("p", 5, "a", "changed"), ("p", 5, "b", "changed"), ("p", 5, "c", "added"), ("p", 7, "a", "removed"), ("p", 7, "b", "removed"), ("p", 7, "c", "removed")]
    assert snapshots.snapshot_changes(prints.limit(0), headers).isEmpty() and snapshots.snapshot_changes(prints, headers.limit(0)).isEmpty()
