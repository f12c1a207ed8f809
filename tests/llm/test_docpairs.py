import ast
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import lexers
from brindle.llm import docpairs, invalid


def documented(doc):
    return bool(docpairs.pairs_of("a.py", f'def run(x):\n    """{doc}"""\n    pass\n'))


@pytest.mark.parametrize("doc", [
    "Empty the cache before shutdown.", "Nothing is written until the lock is free.", "Produced by the parser, one entry a line.",
    "Written by the night job to the ledger.", "return the cached copy (or build one)", "if a berth is free (or soon will be), take it\nand tell the harbour master",
])
def test_prose(doc):
    assert documented(doc)


@pytest.mark.parametrize("doc", ["Empty.", "none yet", "stub implementation", "dummy", "TODO: document", "Generated by the wizard.", "Created by Visual Studio", "return x.close();", "if (x > 1):\n    y = x"])
def test_trivial(doc):
    assert not documented(doc)


CSHARP = """using System;
namespace A.B;
/// <summary>Keeps the berths.</summary>
public partial class Quay<T> where T : class
{
    /// <summary>Opens the ledger of the night.</summary>
    /// <param name="x">The x.</param>
    [Obsolete]
    public Quay(int x) : this() { }

    /** <summary>Moves every
     * crate to a free quay.</summary> */
    public async System.Threading.Tasks.Task<List<T>> Move<U>(ref U from, params int[] to) where U : new() => await Run();

    // Only a comment about the tide.
    void Plain() { }
#if NEVER
    /// <summary>Disabled text of some length.</summary>
    void Disabled() { }
#endif
    /// <summary>Holds a count of things left.</summary>
    int Count { get; set; }
    string s = "/// <summary>not a doc</summary> void F() { }";
    interface IInner
    {
        /// <inheritdoc/>
        void Inherited();
        /// <summary>Waits for the tide to turn.</summary>
        void Wait();
    }
}
"""


def test_csharp():
    got = [(line, symbol, doc) for line, _, symbol, _, doc in docpairs.pairs_of("x/Quay.CS", CSHARP)]
    assert got == [
        (8, "A.B.Quay.Quay", "Opens the ledger of the night."),
        (13, "A.B.Quay.Move", "Moves every crate to a free quay."),
        (29, "A.B.Quay.IInner.Wait", "Waits for the tide to turn."),
    ]


def test_python_like_the_exact_parser(spark):
    """Documented functions, before the filter, with line and symbol, over all Python files of a table."""
    texts = {r.text for r in spark.read.parquet("/root/testdata/sf0.01/source_files.parquet").filter("path like '%.py' and text is not null").collect()}
    seen = 0
    for text in texts:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        want = set()

        def walk(node, outer, want=want):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = [*outer, child.name]
                    if not isinstance(child, ast.ClassDef) and ast.get_docstring(child, clean=False) is not None:
                        want.add((min([child.lineno, *(d.lineno for d in child.decorator_list)]), ".".join(name)))
                    walk(child, name)
                else:
                    walk(child, outer)

        walk(tree, [])
        tokens = lexers.lex_python(text)
        breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
        got = {(sum(b <= p.start for b in breaks) + 1, p.symbol) for p in docpairs.functions_of("python", tokens, text)}
        assert got == want and invalid.verdict("python", text)[0] == "ok"
        seen += len(want)
    assert seen > 50


def test_rows(spark):
    f = 'def run(x):\n    """{}"""\n'
    rows = [("p", "a.py", f.format("Old words of the first draft."), 1), ("p", "a.py", f.format("Waits until the tide has turned."), 2), ("p", "a.py", f.format("Waits until the tide has turned."), 2), ("p", "b.py", None, 1), (None, "c.py", f.format("Moves each crate to a quay."), None), ("p", "d.py", "def run(:", 1), ("p", None, f.format("No path at all here."), 1)]
    files = spark.createDataFrame(rows, "project string, path string, text string, at int").withColumns({"ingested_at": F.timestamp_seconds("at"), "symbol": F.lit("clash"), "pairs": F.lit(1)})
    got = {(r.project, r.path, r.start_line, r.end_line, r.symbol, r.doc) for r in docpairs.documented_functions(files).collect()}
    assert got == {("p", "a.py", 1, 2, "run", "Waits until the tide has turned."), (None, "c.py", 1, 2, "run", "Moves each crate to a quay.")}
    assert docpairs.found(files).count() == 2 and docpairs.found(files.limit(0)).isEmpty()
