"""The structural chunker: behaviours by example."""

import pytest

from brindle.operators import csharp


def chunks(body, head="namespace Acme;\n"):
    return [(c[2], c[3], c[4]) for c in csharp.structural_chunks("f.cs", head + body)]


@pytest.mark.parametrize("member, kind, symbol, signature", [
    ("public static bool TryCombine(ref int a, out int b, params int[] values) { b = a; return true; }", "Method", "TryCombine", "public static bool TryCombine(ref int a, out int b, params int[] values)"),
    ("public static bool IsLong(this string s, int most = 5) => s.Length > most;", "Method", "IsLong", "public static bool IsLong(this string s, int most)"),
    ("public async Task<Dictionary<string, List<int>>> Run<T, U>(Func<T, U> f) where T : class => null;", "Method", "Run", "public async Task<Dictionary<string, List<int>>> Run<T, U>(Func<T, U> f)"),
    ("public const string Kind = \"a;b{\";", "Field", "Kind", "public const string Kind"),
    ("public static readonly string[] Known = new[] { \"A\", \"B\" };", "Field", "Known", "public static readonly string[] Known"),
    ("public static T operator *(T left, T right) => left;", "Method", "operator *", "public static T operator *(T left, T right)"),
    ("public static bool operator >=(T left, T right) { return true; }", "Method", "operator >=", "public static bool operator >=(T left, T right)"),
    ("public static implicit operator string(T value) => \"\";", "Method", "implicit operator string", "public static implicit operator string(T value)"),
    ("public string this[string key] => key;", "Property", "this[]", "public string this[string key]"),
    ("public event EventHandler? Updated;", "Field", "Updated", "public event EventHandler? Updated"),
    ("public event EventHandler? Changed { add { } remove { } }", "Field", "Changed", "public event EventHandler? Changed"),
    ("public int? Count { get; private set; } = 3;", "Property", "Count", "public int? Count"),
    ("public (int A, string B) Pair => (1, \"\");", "Property", "Pair", "public (int A, string B) Pair"),
    ("internal T(int a) : this(a, new[] { 1 }) { }", "Constructor", "T", "internal T(int a)"),
    ("void IDisposable.Dispose() { }", "Method", "Dispose", "void Dispose()"),
    ("public required string Name { get; init; }", "Property", "Name", "public required string Name"),
])
def test_member(member, kind, symbol, signature):
    assert (kind, f"Acme.T.{symbol}", signature) in chunks(f"public class T\n{{\n    {member}\n    int after;\n}}\n")


@pytest.mark.parametrize("member", ["private int _count;", "~T() { }", "static int x = 5, y;"])
def test_no_chunk(member):
    assert chunks(f"class T {{ {member} }}") == [("Class", "Acme.T", "class T")]


def test_several_variables_share_the_owner():
    got = csharp.structural_chunks("f.cs", "class T\n{\n    public const int A = 1,\n        B = 2;\n}\n")
    assert [c[:4] for c in got[1:]] == [(3, 4, "Field", "T.A"), (3, 4, "Field", "T.B")]


def test_types_nesting_order_and_delegates():
    source = """namespace N.M
{
    public record class Money(decimal Amount);
    enum E : byte { A = 1, [X] B, C }
    public class Outer<T>
    {
        public delegate void Callback(int x);
        class Inner { void I() { } }
        void O() { }
    }
    delegate int Top();
    static class Ext { extension(string s) { public bool IsLong => s.Length > 10; } }
    readonly ref struct R { }
}
"""
    got = chunks(source, "")
    assert [g[:2] for g in got] == [
        ("Record", "N.M.Money"), ("Enum", "N.M.E"), ("Class", "N.M.Outer"), ("Method", "N.M.Outer.O"), ("Class", "N.M.Outer.Inner"), ("Method", "N.M.Outer.Inner.I"),
        ("Class", "N.M.Ext"), ("Property", "N.M.Ext.IsLong"), ("Struct", "N.M.R"), ("Method", "N.M.Outer.Callback"), ("Method", "N.M.Top"),
    ]
    assert [g[2] for g in got if g[0] in ("Record", "Class", "Struct")][:2] == ["public record class Money", "public class Outer<T>"]
    bodies = {c[3]: c[6].split("Code:\n")[1] for c in csharp.structural_chunks("f.cs", source)}
    assert bodies["N.M.E"] == "A, B, C" and bodies["N.M.Outer"] == "Callback, Inner, O"


def test_documentation_lines_and_embed_text():
    source = "class T\n{\n    /// <summary>Adds two\n    /// numbers.</summary>\n    /// <param name=\"a\">The first.</param>\n    [Pure]\n    int Add(int a) => a;\n}\n"
    c = csharp.structural_chunks("a/f.cs", source)[1]
    assert c[:2] == (6, 7) and c[5] == "Adds two numbers. The first."
    assert c[6] == "File: a/f.cs\nSymbol: T.Add\nKind: Method\nSignature: int Add(int a)\nDoc: Adds two numbers. The first.\nCode:\n[Pure]\n    int Add(int a) => a;"
    assert csharp.clean_doc("/**\n * <b>x</b>\n */") == "x"


def test_no_pair_is_cut():
    assert csharp.truncate("a" * 1999 + "😀b") == "a" * 1999 and csharp.truncate("a" * 1998 + "😀b") == "a" * 1998 + "😀"


@pytest.mark.parametrize("text", ["class {", "}}}", "class A { void M( { }", "namespace", "public", "class A { int", "[[[", "class A { event", "operator", "class A<", "#if X", "﻿"])
def test_never_fails(text):
    assert all(len(c) == 7 for c in csharp.chunks_of("f.cs", text))


def test_routing(spark):
    rows = [("p", "a.CS", "class A { }"), ("p", "b.cs", "// nothing"), ("p", "c.md", "x\n" * 250), ("p", "d.cs", None), ("p", "e.md", ""), ("p", None, "x")]
    got = {(r.path, r.kind, r.start_line, r.end_line) for r in csharp.chunk_files(spark.createDataFrame(rows, "project string, path string, text string")).collect()}
    assert got == {("a.CS", "Class", 1, 1), ("b.cs", "FileFragment", 1, 1), ("c.md", "FileFragment", 1, 100), ("c.md", "FileFragment", 81, 180), ("c.md", "FileFragment", 161, 250)}
