import itertools

import pytest
from pyspark.sql import functions as F

from brindle.llm import invalid


@pytest.mark.parametrize("text", ["f(a=1, 2)\n", "def f(a=1, b):\n    pass\n", "def f(**k, a):\n    pass\n"])
def test_order_of_arguments(text):
    assert invalid.verdict("python", text)[0] == "token"


def test_valid_python():
    assert invalid.verdict("python", "def f(a, b=1, *c, d, **k):\n    return f(a, *c, d=1, **k)\n")[0] == "ok"


@pytest.mark.parametrize("text", ["f(*a, b, c=1, *d, e=2, **g, h=3)", "f(x for x in y)", "f(a,)", "f()", "f(**a, b=1,)"])
@pytest.mark.parametrize("head", ["{}", "class A({}): pass"])
def test_arguments_like_the_exact_parser(text, head):
    text = head.format(text if head == "{}" else text[2:-1]) + "\n"
    want = "for" not in text or not text.startswith("class")
    assert invalid._exact("python", text) == want and (invalid.verdict("python", text)[0] == "ok") == want


PARAMETERS = ["a", "a=1", "*", "*a", "**k", "/", "b", "b=2", "a: int", "*a: int"]


@pytest.mark.parametrize("form", ["def f({}): pass\n", "lambda {}: 1\n"])
def test_parameters_like_the_exact_parser(form):
    """All lists of up to three; the derivative alone must decide as the exact parser does."""
    grammar, start = invalid._GRAMMARS["python"]()
    for n in (1, 2, 3):
        for some in itertools.product(PARAMETERS, repeat=n):
            names = [p.strip("*").split(":")[0].split("=")[0] for p in some if p not in "/*"]
            if len(names) > len(set(names)) or "lambda" in form and any(":" in p for p in some):
                continue
            text = form.format(", ".join(some))
            assert (grammar.run(start, invalid._LEXERS["python"](text).kinds)[0] == "ok") == invalid._exact("python", text), text


@pytest.mark.parametrize("language, text", [
    ("csharp", "class A { int x = " + "(" * 400 + "1" + ")" * 400 + "; }"), ("csharp", "class A { void M() " + "{" * 5000 + "}" * 5000 + " }"),
    ("json", "[" * 50_000 + "]" * 50_000), ("xml", "<a>" * 20_000 + "</a>" * 20_000),
])
def test_deep_nesting(language, text):
    assert invalid.verdict(language, text)[0] == "ok"
    assert invalid.verdict(language, text[:-3])[0] != "ok"


@pytest.mark.parametrize("language, text, status", [
    ("python", 'def f():\n    """An open', "end"), ("python", "x = (1,\n", "end"), ("python", "def f(:\n    pass\n", "token"), ("python", "x = 1 +* 2\ny = 3\n", "token"),
    ("csharp", "class A { /* open", "end"), ("csharp", "class A { int x = ", "end"), ("csharp", "class A { int int; }", "token"), ("csharp", "<<<<<<< HEAD\nclass A { }", "token"), ("csharp", "", "ok"), ("csharp", "\ufeffclass A;", "ok"),
    ("json", '{"a": [1, 2', "end"), ("json", '{"a": "open', "end"), ("json", "{} {}", "token"), ("json", "", "end"), ("json", "[NaN]", "token"),
    ("xml", "<a><b></b>", "end"), ("xml", "<a><b", "end"), ("xml", "<a></b>", "token"), ("markdown", "<<<<", "ok"), (None, "x", "unknown"), ("python", None, "unknown"),
])
def test_verdicts(language, text, status):
    assert invalid.verdict(language, text)[0] == status


def test_rows(spark):
    """Repeated, late, null and clashing columns; the row ingested last counts."""
    rows = [("p", "a.py", "x = (", 1, "v"), ("p", "a.py", "x = 1\n", 2, "v"), ("p", "b.py", None, 1, "v"), ("p", "c.JSON", "{", 1, "v"), (None, "d.json", "{", 1, "v"), ("p", None, "{", 1, "v"), ("p", "e.md", "{", 1, "v"), ("p", "f.txt", "{", None, "v")]
    files = spark.createDataFrame(rows, "project string, path string, text string, ingested_at int, status string").withColumn("ingested_at", F.timestamp_seconds("ingested_at"))
    assert {(r.project, r.path) for r in invalid.invalid_files(files).collect()} == {("p", "c.JSON"), (None, "d.json")}
    rates = {(r.project, r.language): (r.files, r.invalid, r.truncated, r.invalid_share) for r in invalid.invalid_rates(files).collect()}
    assert rates["p", "python"] == (2, 0, 0, 0.0) and rates["p", "json"] == (1, 1, 1, 1.0) and rates["p", None] == (2, 0, 0, None)
    assert invalid.invalid_files(files.limit(0)).isEmpty()
