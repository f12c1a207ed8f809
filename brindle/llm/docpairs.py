"""Problem 4: functions paired with their documentation.

Packrat grammars (``peg.py``) over the token streams of C# and Python find types, namespaces,
functions and their documentation, with source offsets; the grammars' semantic actions emit one pair a
function; pairs whose documentation says nothing beyond the declaration are dropped.
"""

from __future__ import annotations

import ast
import html
import re
import sys
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexers
from .invalid import language_of, parsed
from .peg import Parser, Peg


@dataclass
class Pair:
    start: int  # offsets of the declaration, attributes and decorators included
    end: int
    name: str
    symbol: str
    params: list[str]
    doc: str  # as written, markers included
    kind: str  # method | constructor | function


_CS_ID = ("id", *lexers.CS_CONTEXTUAL)
_CS_PREDEF = tuple("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_CS_MODS = tuple("public private protected internal static abstract sealed virtual override readonly extern unsafe volatile new async partial required ref file const fixed scoped".split())


def _csharp_grammar(g: Peg) -> Parser:
    seq, alt, many, opt, tok, but, rule = g.seq, g.alt, g.many, g.opt, g.tok, g.but, g.rule
    ident = tok(*_CS_ID)
    braces, parens, squares = g.balanced("{", "}"), g.balanced("(", ")"), g.balanced("[", "]")
    type_ = rule("type", lambda: seq(
        alt(tok(*_CS_PREDEF), seq(opt(seq(ident, tok("::"))), part, many(seq(tok("."), part))), parens, seq(tok("delegate"), tok("*"), opt(tok("managed", "unmanaged")), opt(squares), typeargs)),
        many(alt(tok("?", "*"), squares)),
    ))
    typeargs = rule("typeargs", lambda: seq(tok("<"), many(alt(tok(",", "ref", "in", "out", "readonly"), squares, type_)), tok(">")))
    part = rule("part", lambda: seq(ident, opt(typeargs)))
    name = rule("name", lambda: seq(opt(seq(ident, tok("::"))), part, many(seq(tok("."), part))))
    attrs = rule("attrs", lambda: many(squares))
    mods = rule("mods", lambda: many(tok(*_CS_MODS)))
    head = rule("head", lambda: seq(attrs, mods))
    to_semicolon = rule("rest", lambda: seq(many(alt(braces, parens, squares, but(";", "{", "(", "[", "}", ")", "]"))), tok(";")))
    body = alt(braces, seq(tok("=>"), to_semicolon), tok(";"))
    constraints = many(seq(tok("where"), ident, tok(":"), many(alt(parens, but("{", ";", "=>", "where", "(")))))
    declared = rule("declared", lambda: ident, keep=True)
    parameters = rule("parameters", lambda: parens, keep=True)
    ctor = rule("constructor", lambda: seq(head, declared, parameters, opt(seq(tok(":"), tok("base", "this"), parens)), body), keep=True)
    method = rule("method", lambda: seq(head, type_, many(seq(part, tok("."))), declared, opt(typeargs), parameters, constraints, body), keep=True)
    kind = alt(tok("class", "struct", "interface"), seq(tok("record"), opt(tok("class", "struct"))))
    until_body = many(alt(parens, squares, but("{", ";", "(", "[", "}")))
    type_decl = rule("typedecl", lambda: seq(head, kind, declared, until_body, alt(seq(tok("{"), many(member), tok("}"), opt(tok(";"))), tok(";"))), keep=True)
    enum = seq(head, tok("enum"), until_body, alt(braces, tok(";")), opt(tok(";")))
    delegate = seq(head, tok("delegate"), g.ahead(tok("*"), False), to_semicolon)
    other = seq(head, many(alt(parens, squares, but("{", ";", "=>", "=", "}", "(", "["))), alt(seq(braces, opt(seq(tok("="), to_semicolon))), seq(tok("=>", "="), to_semicolon), tok(";")))
    member = rule("member", lambda: alt(type_decl, enum, delegate, ctor, method, other))
    space_name = rule("spacename", lambda: name, keep=True)
    top = rule("top", lambda: alt(
        seq(tok("extern"), to_semicolon),
        seq(opt(tok("global")), tok("using"), g.ahead(tok("("), False), to_semicolon),
        namespace, file_space, type_decl, enum, delegate, braces, parens, squares, but("}"),
    ))
    namespace = rule("namespace", lambda: seq(tok("namespace"), space_name, tok("{"), many(top), tok("}"), opt(tok(";"))), keep=True)
    file_space = rule("filespace", lambda: seq(tok("namespace"), space_name, tok(";")), keep=True)
    return many(top)


def _python_grammar(g: Peg) -> Parser:
    seq, alt, many, opt, tok, but, rule = g.seq, g.alt, g.many, g.opt, g.tok, g.but, g.rule
    ident = tok("id", "match", "case", "type")
    parens, squares, braces = g.balanced("(", ")"), g.balanced("[", "]"), g.balanced("{", "}")
    brackets = alt(parens, squares, braces, g.balanced("f(", "f)"))
    lambda_ = seq(tok("lambda"), many(alt(brackets, but(":", "newline"))), tok(":"))
    header = many(alt(lambda_, brackets, but(":", "newline")))
    line = rule("line", lambda: seq(many(alt(brackets, but("newline", "indent", "dedent"))), tok("newline")))
    string = rule("string", lambda: seq(tok("str"), many(tok("str"))), keep=True)
    doc = seq(many(tok("(")), string, many(tok(")")), g.ahead(tok("newline", ";")))
    declared = rule("declared", lambda: ident, keep=True)
    parameters = rule("parameters", lambda: parens, keep=True)
    suite = rule("suite", lambda: seq(tok(":"), alt(seq(tok("newline"), tok("indent"), opt(seq(g.ahead(doc), rule_doc)), many(statement), tok("dedent")), seq(opt(seq(g.ahead(doc), rule_doc)), line))))
    rule_doc = rule("doc", lambda: seq(doc, opt(tok("newline"))), keep=True)
    decorators = many(seq(tok("@"), line))
    function = rule("function", lambda: seq(decorators, opt(tok("async")), tok("def"), declared, opt(squares), parameters, header, suite), keep=True)
    class_ = rule("class", lambda: seq(decorators, tok("class"), declared, header, suite), keep=True)
    compound = rule("compound", lambda: seq(opt(tok("async")), tok("if", "elif", "else", "for", "while", "try", "except", "finally", "with"), header, suite))
    soft = rule("soft", lambda: seq(tok("match", "case"), header, tok(":"), tok("newline"), tok("indent"), many(statement), tok("dedent")))
    soft_line = rule("softline", lambda: seq(tok("case"), header, suite))
    statement = rule("statement", lambda: alt(function, class_, compound, soft, soft_line, line))
    return many(statement)


class _CSharp:
    """Semantic actions of the C# grammar: they keep the enclosing names and emit a pair at a function's
    parameters. The grammar is built once a process."""

    def __init__(self) -> None:
        self.peg = Peg()
        self.start = _csharp_grammar(self.peg)
        scope = self._scope
        self.actions = {"namespace": scope, "typedecl": scope, "filespace": scope, "method": self._function, "constructor": self._function, "spacename": self._name, "declared": self._name, "parameters": self._parameters}

    def pairs(self, tokens: lexers.Tokens, text: str) -> list[Pair]:
        self.tokens, self.text, self.out = tokens, text, []
        self.open: list[list] = []  # [end, name] of what encloses
        self.file_space, self.waiting = "", None  # waiting: [name, scope, rule, start, end]
        self.peg.parse(self.start, tokens.kinds, self.actions)
        return self.out

    def _leave(self, i: int) -> None:
        while self.open and self.open[-1][0] <= i:
            self.open.pop()

    def _scope(self, rule: str, i: int, j: int) -> None:
        self._leave(i)
        self.open.append([j, ""])
        self.waiting = ["", self.open[-1], rule, i, j]

    def _function(self, rule: str, i: int, j: int) -> None:
        self._leave(i)
        self.waiting = ["", None, rule, i, j]

    def _name(self, rule: str, i: int, j: int) -> None:
        self._leave(i)
        if self.waiting and not self.waiting[0]:
            t, text = self.tokens, self.text
            name = text[t.starts[i] : t.ends[j - 1]] if rule == "declared" else "".join(text[t.starts[k] : t.ends[k]] for k in range(i, j))
            self.waiting[0] = name = name.removeprefix("@")
            if self.waiting[1] is not None:
                self.waiting[1][1] = name
                if self.waiting[2] == "filespace":
                    self.file_space = name

    def _parameters(self, rule: str, i: int, j: int) -> None:
        self._leave(i)
        if not self.waiting or self.waiting[2] not in ("method", "constructor"):
            return
        name, _, kind, a, b = self.waiting
        self.waiting = None
        doc = _cs_doc(self.tokens, a, self.text)
        if doc is not None:
            outer = [s[1] for s in self.open]
            if self.file_space and self.file_space not in outer[:1]:
                outer.insert(0, self.file_space)
            starts, ends, kinds = self.tokens.starts, self.tokens.ends, self.tokens.kinds
            params = [self.text[starts[k] : ends[k]] for k in range(i, j) if kinds[k] in _CS_ID and kinds[k + 1] in (",", ")", "=")]
            self.out.append(Pair(starts[a], ends[b - 1], name, ".".join([*outer, name]), params, doc, kind))


def _cs_doc(tokens: lexers.Tokens, i: int, text: str) -> str | None:
    """The documentation comment that belongs to the declaration at token i: the last run of
    documentation comments in front of it; comments and directives may follow the run."""
    run: list[str] = []
    for start, end, is_doc in reversed(tokens.trivia.get(i, ())):
        if is_doc:
            run.append(text[start:end])
        elif run:
            break
    return "\n".join(reversed(run)) if run else None


class _Python:
    """Semantic actions of the Python grammar: a function's pair is emitted at its docstring."""

    def __init__(self) -> None:
        self.peg = Peg()
        self.start = _python_grammar(self.peg)
        self.actions = {"function": self._scope, "class": self._scope, "declared": self._name, "parameters": self._parameters, "doc": self._leave, "string": self._string}

    def pairs(self, tokens: lexers.Tokens, text: str) -> list[Pair]:
        self.tokens, self.text, self.out = tokens, text, []
        self.open: list[dict] = []  # end, first, name, params (once they are known), done
        self.peg.parse(self.start, tokens.kinds, self.actions)
        return self.out

    def _leave(self, rule: str, i: int, j: int) -> None:
        while self.open and self.open[-1]["end"] <= i:
            self.open.pop()

    def _scope(self, rule: str, i: int, j: int) -> None:
        self._leave(rule, i, j)
        self.open.append({"first": i, "end": j, "name": None, "params": None, "done": False})

    def _name(self, rule: str, i: int, j: int) -> None:
        self._leave(rule, i, j)
        if self.open and self.open[-1]["name"] is None:
            self.open[-1]["name"] = self.text[self.tokens.starts[i] : self.tokens.ends[i]]

    def _parameters(self, rule: str, i: int, j: int) -> None:
        self._leave(rule, i, j)
        starts, ends, kinds = self.tokens.starts, self.tokens.ends, self.tokens.kinds
        if self.open and self.open[-1]["params"] is None:
            self.open[-1]["params"] = [self.text[starts[k] : ends[k]] for k in range(i, j) if kinds[k] in ("id", "match", "case", "type") and kinds[k + 1] in (",", ")", "=", ":")]

    def _string(self, rule: str, i: int, j: int) -> None:
        self._leave(rule, i, j)
        own = self.open[-1] if self.open else None
        if own is None or own["done"] or own["params"] is None:
            return
        starts, ends = self.tokens.starts, self.tokens.ends
        raw = "".join(self.text[starts[k] : ends[k]] + " " for k in range(i, j))
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                doc = ast.literal_eval(raw.strip())
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return
        if isinstance(doc, str):
            last = own["end"] - 1
            while last > own["first"] and starts[last] == ends[last]:
                last -= 1
            own["done"] = True
            self.out.append(Pair(starts[own["first"]], ends[last], own["name"], ".".join(s["name"] for s in self.open), own["params"], doc, "function"))


_emitters: dict[str, _CSharp | _Python] = {}


def functions_of(language: str, tokens: lexers.Tokens, text: str) -> list[Pair]:
    """The functions of a valid text of C# or Python that have a documentation."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    if language not in _emitters:
        _emitters[language] = _CSharp() if language == "csharp" else _Python()
    return _emitters[language].pairs(tokens, text)


# ---- documentation -----------------------------------------------------------------------------
_SECTION_TAGS = re.compile(r"<(param|typeparam|returns?|exception|value|permission|seealso)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.S | re.I)
_HIDDEN_TAGS = re.compile(r"<(inheritdoc|include)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_FIELD = re.compile(r"^[ \t]*(?:[:@\\](?:param|parameter|arg|argument|key|keyword|type|raises?|throws?|exception|returns?|rtype|yields?|ytype|tparam|typeparam)\b)", re.I)
_HEAD = re.compile(r"^[ \t]*(?:args?|arguments?|param(?:eter)?s?|other parameters|keyword arg(?:ument)?s?|returns?|yields?|raises?|throws?|exceptions?|errors?|results?)[ \t]*:?[ \t]*$", re.I)
_HEAD_INLINE = re.compile(r"^[ \t]*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|results?)[ \t]*:(?!:)[ \t]*\S", re.I)
_OTHER_HEAD = re.compile(r"^[ \t]*(?:notes?|examples?|see also|warnings?|references?|attributes|todo|usage|warns|summary)[ \t]*:?[ \t]*$", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+|\d+")


def clean_csharp(doc: str) -> str:
    """The text of a documentation comment without comment markers, XML markup and the sections on
    parameters, results and errors."""
    return re.sub(r"\s+", " ", _csharp_lines(doc)).strip()


def _csharp_lines(doc: str) -> str:
    """The same in its lines."""
    if doc.lstrip().startswith("/**"):
        doc = re.sub(r"^\s*/\*\*|\*/\s*$", "", doc)
        doc = re.sub(r"^[ \t]*\*[ \t]?", "", doc, flags=re.M)
    doc = re.sub(r"^[ \t]*///[ \t]?", "", doc, flags=re.M)
    doc = re.sub(r"^[ \t]*/\*\*|\*/[ \t]*$", "", doc, flags=re.M)
    doc = _SECTION_TAGS.sub(" ", doc)
    doc = _HIDDEN_TAGS.sub(" ", doc)
    return _sections(html.unescape(_TAG.sub(" ", doc)))


def clean_python(doc: str) -> str:
    """A docstring without field lists and the sections on parameters, results and errors in the
    common styles (reST fields, indented or underlined headings)."""
    return re.sub(r"\s+", " ", _sections(doc)).strip()


def _sections(doc: str) -> str:
    out: list[str] = []
    lines = re.split(r"\r\n|\r|\n", doc.expandtabs())
    skip_until: int | None = None  # indentation of the heading under which lines are dropped
    underlined = False
    k = 0
    while k < len(lines):
        line = lines[k]
        indent = len(line) - len(line.lstrip())
        rule_next = k + 1 < len(lines) and re.fullmatch(r"\s*[-=~]{3,}\s*", lines[k + 1])
        if _HEAD.match(line) and (line.rstrip().endswith(":") or rule_next):
            skip_until, underlined = indent, bool(rule_next)
            k += 2 if rule_next else 1
            continue
        if rule_next and line.strip() or _OTHER_HEAD.match(line):
            skip_until = None
        elif _FIELD.match(line):
            skip_until, underlined = indent, False
            k += 1
            continue
        elif _HEAD_INLINE.match(line):
            skip_until, underlined = indent, False
            k += 1
            continue
        if skip_until is not None:
            if not line.strip() or indent > skip_until or underlined:
                k += 1
                continue
            skip_until = None
        out.append(line)
        k += 1
    return "\n".join(out)


# Words that carry no description in a one-line comment, by language.
_FILLER = frozenset(
    """a an the this that these those is are be been of to for in on and or with from by at as it its
    method methods function functions func fn procedure routine member members operation call calls
    constructor constructors ctor class type interface struct record instance object value values
    parameter parameters param params argument arguments arg args result results return returns
    does do done perform performs performing implementation implements implement handle handles
    helper utility util used use uses using which given specified provided new
    self cls none null void init initialize initializes initialise initialises initializer inits create
    creates construct constructs constructing initializing asynchronously asynchronous async sync
    name called named here""".split()
)
_PLACEHOLDER = re.compile(
    r"""^\W*(?:
      (?:todo|fixme|tbd|tba|tbc|xxx|wip|n/?a|placeholder|undocumented|untitled|lorem\ ipsum)\b.*
    | (?:hack|none|nothing|null|empty|stub|dummy)(?:\W+(?:yet|here|for\ now|so\ far|only|method|function|constructor|implementation|body|text|documentation|description|docs?|docstring|comment|summary|placeholder|value|todo|tbd|to\ (?:see|say|document|describe|add)))*\W*
    | (?:to\ be\ (?:done|documented|defined|written|determined|added|completed|described)|work\ in\ progress|coming\ soon|not\ (?:yet\ )?(?:documented|implemented|described)|undocumented)\b.*
    | (?:no|missing)\ (?:documentation|description|comment|comments|summary|docs?|docstring)\b.*
    | (?:documentation|description|docs?|docstring|comment|summary)(?:\W+(?:goes\ here|here|missing|pending|needed|required|to\ follow|to\ come|tbd|todo|is\ missing|not\ available|unavailable|text))?\W*
    | (?:please\ )?(?:add|write|insert|enter|put|provide|fill\ in)\ (?:a\ |an\ |the\ |your\ |some\ )?(?:\w+\ )?(?:documentation|description|summary|comment|docs?|docstring|text)\b.*
    | (?:same\ as|see|inherits?|inherited|copied|refer\ to)\b\W*(?:the\ )?(?:documentation\ )?(?:from\ |in\ |of\ |to\ )?(?:the\ )?(?:base|parent|super(?:class)?|overridden|interface|inherited|declaring|implemented)\b.*
    | inherit(?:ed|s)?(?:\ ?doc)?s?\b.{0,60}
    | \{?@inherit[Dd]oc\}?.*
    | (?:for\ |this\ is\ for\ |this\ method\ is\ for\ )?(?:internal|private)(?:\ |-)?(?:use|usage|purposes?|api)?(?:\ only)?\W*
    | (?:for\ |intended\ for\ |this\ \w+\ is\ (?:intended\ )?for\ |reserved\ for\ )?internal\ (?:use|usage|purposes?)\b.{0,60}
    | this\ (?:api|method|member|type|class)\ (?:supports|is\ intended\ for|is\ not\ intended)\b.*(?:infrastructure|internal|directly)\b.*
    | (?:do\ not\ use|not\ (?:meant|intended)\ (?:for|to))\b.{0,80}(?:public|outside|directly|code|external)\b.*
    | (?:this\ \w+\ (?:was|is)\ )?auto(?:matically)?[-\ ]?generated\b.*
    | (?:generated|created|written|produced)\ by\ (?:a\ |an\ |the\ )?(?:[\w.]+\ )?(?:visual\ studio|wizard|templates?|tools?|ghostdoc|resharper|roslynator|code\ ?gen\w*|generator|designer|scaffold\w*|scripts?|copilot|chatgpt|ide)\b.{0,60}
    | (?:this\ (?:code|file|method|class)\ was\ (?:auto|generated)).*
    | (?:ghostdoc|resharper|roslynator|stylecop|pylint|noqa|type:\ ?ignore|pragma)\b.*
    )$""",
    re.X | re.I | re.S,
)
_CODE = re.compile(r"(?:[;{}]\s*$|^\s*(?:var|return|if|for|foreach|while|def|import|from|public|private|internal|protected|using|await|throw|raise|print|self\.|this\.)\b.*(?:[;:{}()=]|\bimport\b)|^[\w.\[\]]+\s*(?:=|\+=|-=)\s*\S+\s*;?$|^[\w.]+\(.*\)\s*;?$)")

#: Four plain words in a row, as prose has them.
_PROSE = re.compile(r"(?:\b[^\W\d_]{2,}[ ,]+){3}[^\W\d_]{2,}")


def _is_code(line: str) -> bool:
    """Whether a line of documentation is code: it looks so and isn't a sentence."""
    return bool(_CODE.search(line)) and (line[-1] in ";{}" or not _PROSE.search(line))


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "ied"):
        if w.endswith(end) and len(w) > 4:
            return w[:-3] + "y"
    for end in ("ing", "ers", "ed", "es", "er", "or", "s", "e"):
        if w.endswith(end) and len(w) - len(end) > 2:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w.removesuffix("e") if len(w) > 3 else w


def _parts(*names: str) -> set[str]:
    out: set[str] = set()
    for n in names:
        for p in _CAMEL.findall(n):
            out.add(_stem(p))
        joined = "".join(_WORD.findall(n)).lower()
        out |= {_stem(joined), joined}
    return out


def is_trivial(doc: str, name: str, symbol: str, params: list[str]) -> bool:
    """Whether a documentation, cleaned and in its lines, says nothing beyond the declaration: no words; only names of
    the function, its types or parameters, in other spelling or with filler; a note that text is
    missing, inherited or internal; boilerplate of a tool; disabled code."""
    if not any(c.isalpha() for c in doc):
        return True
    lines = [x.strip() for x in re.split(r"[\r\n]+", doc) if x.strip()]
    if _PLACEHOLDER.match(" ".join(doc.split())):
        return True
    if all(map(_is_code, lines)):
        return True
    known = _parts(name, *symbol.split("."), *params)
    words = [p for w in re.findall(r"[^\W_]+", doc) for p in _CAMEL.findall(w)]
    return all(w.lower() in _FILLER or _stem(w) in known or w.lower() in known or len(w) == 1 and w.isascii() for w in words)


def pairs_of(path: str | None, text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start_line, end_line, symbol, code, documentation) of the documented functions of a file;
    none for a null text, another language, or a text that isn't valid."""
    language = language_of(path)
    if language not in ("csharp", "python") or text is None:
        return []
    status, _, tokens = parsed(language, text)
    if status != "ok":
        return []
    out = []
    csharp = language == "csharp"
    breaks = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    for p in functions_of(language, tokens, text):
        doc = _csharp_lines(p.doc) if csharp else _sections(p.doc)
        if not is_trivial(doc, p.name, p.symbol, p.params):
            out.append((bisect_right(breaks, p.start) + 1, bisect_right(breaks, max(p.start, p.end - 1)) + 1, p.symbol, text[p.start : p.end], " ".join(doc.split())))
    return out


_PAIR = pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("symbol", pa.string()), ("code", pa.string()), ("doc", pa.string())])


def _of_files(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append([{"start_line": s, "end_line": e, "symbol": sym} | ({"code": c, "doc": d} if texts else {}) for s, e, sym, c, d in pairs_of(path, text)])
        kind = pa.list_(_PAIR if texts else pa.struct([_PAIR.field(i) for i in range(3)]))
        yield pa.RecordBatch.from_arrays([batch.column("project"), batch.column("path"), batch.column("at"), pa.array(rows, kind)], names=["project", "path", "at", "pairs"])


def _pairs(files: DataFrame, texts: bool) -> DataFrame:
    """Every row's pairs, then the row ingested last of each file: one scan, and source texts aren't
    shuffled. Without ``texts`` neither are code and documentation."""
    at = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))).alias("at")
    kind = "start_line int, end_line int, symbol string" + ", code string, doc string" * texts
    seen = files.select("project", "path", "text", at).mapInArrow(lambda b: _of_files(b, texts), f"project string, path string, at bigint, pairs array<struct<{kind}>>")
    last = seen.groupBy("project", "path").agg(F.max_by("pairs", F.struct("at", "pairs")).alias("pairs"))
    return last.select("project", "path", F.inline("pairs")).dropDuplicates(["project", "path", "start_line", "symbol"])


def documented_functions(files: DataFrame) -> DataFrame:
    """Pairs of code and description: project, path, start_line, end_line, symbol, code, doc.

    ``files`` has project, path, text, ingested_at; more columns are ignored. Of repeated rows of a
    file the one ingested last stands, of several at the same time always the same one. Null texts, files
    of other languages and files that don't parse give no pairs; so does an empty table. Of functions that
    start on one line under one symbol one pair is kept. Null project or path is a value like others.
    """
    return _pairs(files, True)


def found(files: DataFrame) -> DataFrame:
    """project, path, start_line, symbol of the functions with non-trivial documentation."""
    return _pairs(files, False).select("project", "path", "start_line", "symbol")
