"""Token streams of C#, Python, JSON and XML with source offsets.

Each lexer gives a ``Tokens``: classes for the grammars, offsets into the text, and for C# the
documentation comments in front of each token. A lexical error is a token of class ``error``, which
no grammar accepts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    #: C#: token index -> [(start, end, is_doc)] of comments and directives in front of it
    trivia: dict[int, list[tuple[int, int, bool]]] = field(default_factory=dict)

    def add(self, kind: str, start: int, end: int) -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.ends.append(end)


# ---- C# ----------------------------------------------------------------------------------------
# The reserved words and the contextual words of C# 13.
CS_RESERVED = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default
    delegate do double else enum event explicit extern false finally fixed float for foreach goto if
    implicit in int interface internal is lock long namespace new null object operator out override
    params private protected public readonly ref return sbyte sealed short sizeof stackalloc static
    string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual
    void volatile while""".split()
)
CS_CONTEXTUAL = frozenset(
    """add alias allows and ascending assembly async await by descending equals file from get global group init
    into join let managed module not on or orderby partial record remove required scoped select set unmanaged
    var when where with yield""".split()
)
_CS_WORDS = {w: w for w in CS_RESERVED | CS_CONTEXTUAL}
_CS_EOL = "\r\n\u0085\u2028\u2029"
_CS_TOKEN = re.compile(
    rf"""
    (?P<ws>[ \t\v\f\u00a0\ufeff\u001a\u1680\u2000-\u200a\u202f\u205f\u3000{_CS_EOL}]+)
  | (?P<lc>//[^{_CS_EOL}]*)
  | (?P<bc>/\*[\s\S]*?\*/)
  | (?P<id>(?:[^\W\d]|\\u[0-9a-fA-F]{{4}})(?:\w|\\u[0-9a-fA-F]{{4}}|[\u0300-\u036f\u00ad\u200b-\u200d])*)
  | (?P<num>0[xX][0-9a-fA-F_]+[uUlL]{{0,2}} | 0[bB][01_]+[uUlL]{{0,2}}
      | (?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9][0-9_]*)?[fFdDmM]?
      | [0-9][0-9_]*(?:[eE][+-]?[0-9][0-9_]*)?(?:[fFdDmM]|[uUlL]{{1,2}})?)
  | (?P<raw>\$*\"{{3,}})
  | (?P<istr>\$@?"|@\$")
  | (?P<vstr>@"(?:[^"]|"")*"(?:u8|U8)?)
  | (?P<str>"(?:[^"\\{_CS_EOL}]|\\(?:['"\\0abfnrtve]|x[0-9a-fA-F]{{1,4}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))*"(?:u8|U8)?)
  | (?P<chr>'(?:[^'\\{_CS_EOL}\U00010000-\U0010ffff]|\\(?:['"\\0abfnrtve]|x[0-9a-fA-F]{{1,4}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')
  | (?P<vid>@[^\W\d]\w*)
  | (?P<pp>\#)
  | (?P<op><<=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|::|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|->|\.\.|[-+*/%&|^!~=<>?:;,.(){{}}\[\]])
    """,
    re.X,
)
_CS_DIRECTIVE = re.compile(rf"\#[ \t]*(\w*)[ \t]*([^{_CS_EOL}]*)")
_CS_BLANK = " \t\v\f\u00a0\ufeff"
_PP_TOKEN = re.compile(r"\s*(&&|\|\||==|!=|!|\(|\)|[^\W\d]\w*)")
_ESCAPE = re.compile(r"""\\(?:['"\\0abfnrtve]|x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})""")


def _pp_value(text: str, defined: set[str]) -> bool | None:
    """The value of a directive's condition; None if it is malformed."""
    words, pos = [], 0
    text = text.split("//")[0].rstrip()
    while pos < len(text):
        m = _PP_TOKEN.match(text, pos)
        if not m:
            return None
        words.append(m[1])
        pos = m.end()
    at = 0

    def unary():
        nonlocal at
        if at >= len(words):
            raise ValueError
        w = words[at]
        at += 1
        if w == "!":
            return not unary()
        if w == "(":
            v = either()
            if at >= len(words) or words[at] != ")":
                raise ValueError
            at += 1
            return v
        if not (w[0].isalpha() or w[0] == "_"):
            raise ValueError
        return w == "true" or w in defined

    def level(ops, below):
        nonlocal at
        v = below()
        while at < len(words) and words[at] in ops:
            op = words[at]
            at += 1
            r = below()
            v = v and r if op == "&&" else v or r if op == "||" else (v == r) == (op == "==")
        return v

    def either():
        return level(("||",), lambda: level(("&&",), lambda: level(("==", "!="), unary)))

    try:
        v = either()
    except (ValueError, RecursionError):
        return None
    return v if at == len(words) else None


class _CSharp:
    def __init__(self, text: str):
        self.t, self.n, self.out = text, len(text), Tokens()
        self.defined: set[str] = set()
        self.ifs: list[bool] = []  # whether a branch of each open #if was taken
        self.regions = 0

    def note(self, start: int, end: int, doc: bool) -> None:
        self.out.trivia.setdefault(len(self.out.kinds), []).append((start, end, doc))

    def fail(self, at: int) -> int:
        self.out.add("error", at, at + 1)
        return self.n

    def line_end(self, at: int) -> int:
        while at < self.n and self.t[at] not in _CS_EOL:
            at += 1
        return at

    def directive(self, at: int) -> int:
        """Handles a directive that starts at ``at``; gives the place after it (and what it disables)."""
        t = self.t
        back = at - 1
        while back >= 0 and t[back] in _CS_BLANK:
            back -= 1
        if back >= 0 and t[back] not in _CS_EOL:
            return self.fail(at)
        m = _CS_DIRECTIVE.match(t, at)
        word, rest, end = m[1], m[2], m.end()
        self.note(at, end, False)
        if word == "if":
            v = _pp_value(rest, self.defined)
            if v is None:
                return self.fail(at)
            self.ifs.append(v)
            return end if v else self.disabled(end)
        if word in ("elif", "else", "endif"):
            if not self.ifs or word == "elif" and _pp_value(rest, self.defined) is None:
                return self.fail(at)
            if word == "endif":
                self.ifs.pop()
                return end
            return self.disabled(end)
        if word in ("define", "undef"):
            name = rest.split("//")[0].strip()
            if self.out.kinds or not name.isidentifier():
                return self.fail(at)
            (self.defined.add if word == "define" else self.defined.discard)(name)
            return end
        if word == "region":
            self.regions += 1
        elif word == "endregion":
            self.regions -= 1
            if self.regions < 0:
                return self.fail(at)
        elif word not in ("line", "pragma", "nullable", "error", "warning", "r", "load") and not (at == 0 and t[1:2] == "!"):
            return self.fail(at)
        return end

    def disabled(self, at: int) -> int:
        """Skips lines up to the branch that is compiled."""
        depth = 0
        while at < self.n:
            while at < self.n and self.t[at] in _CS_EOL:
                at += 1
            p = at
            while p < self.n and self.t[p] in _CS_BLANK:
                p += 1
            end = self.line_end(p)
            if p < self.n and self.t[p] == "#":
                m = _CS_DIRECTIVE.match(self.t, p)
                word = m[1]
                if word == "if":
                    depth += 1
                elif word == "endif":
                    if not depth:
                        self.ifs.pop()
                        return end
                    depth -= 1
                elif word in ("else", "elif") and not depth and not self.ifs[-1]:
                    v = True if word == "else" else _pp_value(m[2], self.defined)
                    if v is None:
                        return self.fail(p)
                    if v:
                        self.ifs[-1] = True
                        return end
            at = end
        return self.n

    def lex(self, at: int, hole: int = 0) -> int:
        """Tokens from ``at``; with hole > 0, up to the end of an interpolation of so many braces."""
        t, n, out, depth = self.t, self.n, self.out, 0
        match, words = _CS_TOKEN.match, _CS_WORDS
        kinds, starts, ends = out.kinds, out.starts, out.ends
        while at < n:
            m = match(t, at)
            if m is None:
                return self.fail(at)
            kind, end = m.lastgroup, m.end()
            if kind == "ws":
                at = end
                continue
            if kind == "id":
                kind = words.get(m.group(), "id")
            elif kind == "op":
                kind = m.group()
                if hole:
                    if kind in "([{":
                        depth += 1
                    elif kind in ")]}":
                        if not depth:
                            if kind == "}" and t.startswith("}" * hole, at):
                                out.add("h)", at, at + hole)
                                return at + hole
                            return self.fail(at)
                        depth -= 1
                    elif kind == ":" and not depth:
                        end = at + 1
                        while end < n and t[end] not in "{}\"" and t[end] not in _CS_EOL:
                            end += 1
                        if not t.startswith("}" * hole, end):
                            return self.fail(at)
                        out.add("hf", at, end)
                        out.add("h)", end, end + hole)
                        return end + hole
            elif kind == "lc":
                s = m.group()
                self.note(at, end, s.startswith("///") and not s.startswith("////"))
                at = end
                continue
            elif kind == "bc":
                s = m.group()
                self.note(at, end, s.startswith("/**") and not s.startswith("/***") and len(s) > 4)
                at = end
                continue
            elif kind == "pp":
                if hole:
                    return self.fail(at)
                at = self.directive(at)
                continue
            elif kind == "raw":
                at = self.raw(at, m.group())
                continue
            elif kind == "istr":
                at = self.interpolated(at, end, "@" in m.group())
                continue
            elif kind == "vstr":
                kind = "str"
            elif kind == "vid":
                kind = "id"
            kinds.append(kind)
            starts.append(at)
            ends.append(end)
            at = end
        if hole:
            return self.fail(n)
        return n

    def interpolated(self, start: int, at: int, verbatim: bool) -> int:
        t, n = self.t, self.n
        self.out.add("i(", start, at)
        while at < n:
            c = t[at]
            if c == '"':
                if verbatim and t.startswith('""', at):
                    at += 2
                    continue
                self.out.add("i)", at, at + 1)
                return at + 1
            if c == "{":
                if t.startswith("{{", at):
                    at += 2
                    continue
                self.out.add("h(", at, at + 1)
                at = self.lex(at + 1, 1)
                continue
            if c == "}":
                if not t.startswith("}}", at):
                    return self.fail(at)
                at += 2
                continue
            if not verbatim:
                if c in _CS_EOL:
                    return self.fail(at)
                if c == "\\":
                    m = _ESCAPE.match(t, at)
                    if not m:
                        return self.fail(at)
                    at = m.end()
                    continue
            at += 1
        return self.fail(n)

    def raw(self, start: int, opening: str) -> int:
        """Raw string literals, interpolated or not, of one line or of several."""
        t, n = self.t, self.n
        dollars = opening.count("$")
        quotes = len(opening) - dollars
        at = start + len(opening)
        eol = self.line_end(at)
        several = eol < n and not t[at:eol].strip(_CS_BLANK)
        if dollars:
            self.out.add("i(", start, at)
        while at < n:
            c = t[at]
            if c == '"':
                run = 1
                while at + run < n and t[at + run] == '"':
                    run += 1
                if run >= quotes:
                    if run > quotes:
                        return self.fail(at)
                    end = at + run
                    if several:
                        line = at
                        while t[line - 1] not in _CS_EOL:
                            line -= 1
                        indent = t[line:at]
                        if indent.strip(_CS_BLANK) or not dollars and any(x.strip(_CS_BLANK) and not x.startswith(indent) for x in re.split(rf"\r\n|[{_CS_EOL}]", t[eol:line])):
                            return self.fail(at)
                    if dollars:
                        self.out.add("i)", at, end)
                    else:
                        end += 2 if t[end : end + 2] in ("u8", "U8") else 0
                        self.out.add("str", start, end)
                    return end
                at += run
            elif c == "{" and dollars:
                run = 1
                while at + run < n and t[at + run] == "{":
                    run += 1
                at += run
                if run >= 2 * dollars:
                    return self.fail(at)
                if run >= dollars:
                    self.out.add("h(", at - dollars, at)
                    at = self.lex(at, dollars)
            elif not several and c in _CS_EOL:
                return self.fail(at)
            else:
                at += 1
        return self.fail(n)


def lex_csharp(text: str) -> Tokens:
    x = _CSharp(text)
    x.lex(0)
    if x.ifs or x.regions > 0:
        x.fail(x.n)
    return x.out


# ---- Python ------------------------------------------------------------------------------------
# The keywords of Python 3.13 (soft keywords are names).
PY_KEYWORDS = frozenset(
    """False None True and as assert async await break class continue def del elif else except finally
    for from global if import in is lambda nonlocal not or pass raise return try while with yield""".split()
)
_PY_SOFT = frozenset(("match", "case", "type"))
_PY_TOKEN = re.compile(
    r"""
    (?P<ws>[ \t\f]+)
  | (?P<nl>\r\n|\r|\n)
  | (?P<comment>\#[^\r\n]*)
  | (?P<cont>\\(?:\r\n|\r|\n))
  | (?P<fstr>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|"))
  | (?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"
       |'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"))
  | (?P<id>[^\W\d]\w*)
  | (?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+
      |(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?
      |[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)
  | (?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|<<|>>|\*\*|//|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^~<>()\[\]{},:.;@=!])
    """,
    re.X,
)
_PY_AUG = frozenset(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=", "**=", "//=", ">>=", "<<="))


class _Python:
    def __init__(self, text: str):
        self.t, self.n, self.out = text, len(text), Tokens()

    def fail(self, at: int) -> int:
        self.out.add("error", at, at + 1)
        return self.n

    def run(self) -> Tokens:
        t, n, out = self.t, self.n, self.out
        at = 1 if t.startswith("\ufeff") else 0
        indents = [(0, 0)]
        brackets: list[str] = []
        fresh = True
        match = _PY_TOKEN.match
        while at < n:
            if fresh and not brackets:
                col = alt = 0
                p = at
                while p < n and t[p] in " \t\f":
                    if t[p] == " ":
                        col, alt = col + 1, alt + 1
                    elif t[p] == "\t":
                        col, alt = (col // 8 + 1) * 8, alt + 1
                    else:
                        col = alt = 0
                    p += 1
                at = p
                if at >= n:
                    break
                if t[at] in "#\r\n":
                    m = match(t, at)
                    at = m.end()
                    if m.lastgroup == "comment":
                        m = match(t, at)
                        at = m.end() if m else at
                    continue
                if t[at] == "\\" and t[at + 1 : at + 2] in ("\r", "\n"):
                    pass
                fresh = False
                if col == indents[-1][0]:
                    if alt != indents[-1][1]:
                        return self.done(self.fail(at))
                elif col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        return self.done(self.fail(at))
                    indents.append((col, alt))
                    out.add("indent", at, at)
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        out.add("dedent", at, at)
                    if (col, alt) != indents[-1]:
                        return self.done(self.fail(at))
            m = match(t, at)
            if m is None:
                return self.done(self.fail(at))
            kind, end = m.lastgroup, m.end()
            if kind in ("ws", "comment"):
                pass
            elif kind == "cont":
                if end >= n:
                    return self.done(self.fail(at))
            elif kind == "nl":
                if not brackets:
                    out.add("newline", at, end)
                    fresh = True
            elif kind == "fstr":
                end = self.fstring(at, end, m.group())
            elif kind == "op":
                s = m.group()
                if s in "([{":
                    brackets.append(s)
                elif s in ")]}":
                    if not brackets or brackets.pop() + s not in ("()", "[]", "{}"):
                        return self.done(self.fail(at))
                out.add("aug" if s in _PY_AUG else s, at, end)
            elif kind == "id":
                s = m.group()
                out.add(s if s in PY_KEYWORDS or s in _PY_SOFT else "id", at, end)
            elif kind == "num" and end < n and (t[end] == "_" or t[m.start()] == "0" and t[end].isdigit() and t[m.start() : end].strip("0_")):
                return self.done(self.fail(at))
            else:
                out.add(kind, at, end)
            at = end
        if brackets:
            self.fail(n)
            return out
        if out.kinds and not fresh and out.kinds[-1] != "newline":
            out.add("newline", n, n)
        for _ in indents[1:]:
            out.add("dedent", n, n)
        return out

    def done(self, _: int) -> Tokens:
        return self.out

    def fstring(self, start: int, at: int, opening: str) -> int:
        quote = opening.lstrip("fFrR")
        raw = "r" in opening[: -len(quote)].lower()
        self.out.add("f(", start, at)
        end = self.middle(at, quote, raw, False)
        return end

    def middle(self, at: int, quote: str, raw: bool, spec: bool) -> int:
        """The literal part of an f-string, or of a format specification, with its holes."""
        t, n = self.t, self.n
        while at < n:
            c = t[at]
            if not spec and t.startswith(quote, at):
                self.out.add("f)", at, at + len(quote))
                return at + len(quote)
            if spec and c == "}":
                return at
            if c == "{":
                if t.startswith("{{", at) and not spec:
                    at += 2
                    continue
                at = self.hole(at, quote, raw)
            elif c == "}":
                if not t.startswith("}}", at):
                    return self.fail(at)
                at += 2
            elif c in "\r\n" and len(quote) == 1:
                return self.fail(at)
            elif c == "\\":
                if not raw and t.startswith("\\N{", at):
                    p = t.find("}", at)
                    if p < 0:
                        return self.fail(at)
                    at = p + 1
                else:
                    at += 1 if t[at + 1 : at + 2] in ("{", "}") else 2
            else:
                at += 1
        return self.fail(n)

    def hole(self, at: int, quote: str, raw: bool) -> int:
        t, n, out = self.t, self.n, self.out
        out.add("h(", at, at + 1)
        at += 1
        brackets: list[str] = []
        while at < n:
            m = _PY_TOKEN.match(t, at)
            if m is None:
                return self.fail(at)
            kind, end = m.lastgroup, m.end()
            if kind in ("ws", "nl", "comment", "cont"):
                at = end
                continue
            if kind == "fstr":
                at = self.fstring(at, end, m.group())
                continue
            s = m.group()
            if kind == "op":
                if not brackets:
                    if s in (":=", ":"):
                        out.add("h:", at, at + 1)
                        at = self.middle(at + 1, quote, raw, True)
                        if at >= n:
                            return n
                        out.add("h)", at, at + 1)
                        return at + 1
                    if s == "}":
                        out.add("h)", at, end)
                        return end
                if s in "([{":
                    brackets.append(s)
                elif s in ")]}":
                    if not brackets or brackets.pop() + s not in ("()", "[]", "{}"):
                        return self.fail(at)
                out.add("aug" if s in _PY_AUG else s, at, end)
            elif kind == "id":
                out.add(s if s in PY_KEYWORDS or s in _PY_SOFT else "id", at, end)
            else:
                out.add(kind, at, end)
            at = end
        return self.fail(n)


def lex_python(text: str) -> Tokens:
    return _Python(text).run()


# ---- JSON --------------------------------------------------------------------------------------
_JSON_TOKEN = re.compile(
    r"""[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")
    |(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<word>true|false|null)|(?P<op>[\[\]{},:])|(?P<end>\Z))""",
    re.X,
)


def lex_json(text: str) -> Tokens:
    out, at, n = Tokens(), 0, len(text)
    while at < n:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            out.add("error", at, at + 1)
            break
        kind = m.lastgroup
        if kind == "end":
            break
        out.add(m.group(kind) if kind == "op" else kind, m.start(kind), m.end())
        at = m.end()
    return out


# ---- XML ---------------------------------------------------------------------------------------
_NAME = "[:A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff][-:A-Z_a-z.0-9\u00b7\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u037d\u037f-\u1fff\u200c-\u200d\u203f\u2040\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff]*"
_REF = rf"&(?:(?P<ent>{_NAME})|\#(?P<dec>[0-9]+)|\#x(?P<hex>[0-9a-fA-F]+));"
_XML_TOKEN = re.compile(
    rf"""(?P<decl><\?xml\s+version\s*=\s*(?:"1\.[0-9]+"|'1\.[0-9]+')(?:\s+encoding\s*=\s*(?:"[A-Za-z][-A-Za-z0-9._]*"|'[A-Za-z][-A-Za-z0-9._]*'))?(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>)
    |(?P<pi><\?(?![xX][mM][lL][\s?]){_NAME}(?:\s[\s\S]*?)?\?>)
    |(?P<comment><!--(?:(?!--)[\s\S])*-->)
    |(?P<cdata><!\[CDATA\[[\s\S]*?\]\]>)
    |(?P<doctype><!DOCTYPE\s+{_NAME}[^\[<>]*(?:\[[^\]]*\]\s*)?>)
    |<(?P<open>{_NAME})(?P<atts>(?:\s+{_NAME}\s*=\s*(?:"[^<"]*"|'[^<']*'))*)\s*(?P<slash>/?)>
    |</(?P<close>{_NAME})\s*>
    |(?P<text>[^<]+)""",
    re.X,
)
_XML_ATT = re.compile(rf"({_NAME})\s*=\s*(\"[^<\"]*\"|'[^<']*')")
_XML_REF = re.compile(_REF)
_XML_CHAR = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_XML_ENTITIES = frozenset(("amp", "lt", "gt", "quot", "apos"))


def _xml_refs(s: str, declared: frozenset[str]) -> bool:
    at = s.find("&")
    while at >= 0:
        m = _XML_REF.match(s, at)
        if not m or m["ent"] and m["ent"] not in declared:
            return False
        code = int(m["dec"]) if m["dec"] else int(m["hex"], 16) if m["hex"] else 32
        if code > 0x10FFFF or _XML_CHAR.match(chr(code)):
            return False
        at = s.find("&", m.end())
    return True


def lex_xml(text: str) -> Tokens:
    """Tags are ``open\\0name`` and ``close\\0name``; white space between them is ``space``."""
    out, at, n = Tokens(), 0, len(text)
    declared = _XML_ENTITIES
    if text.startswith("\ufeff"):
        at = 1
    first = at
    bad = _XML_CHAR.search(text, at)
    stop = bad.start() if bad else n
    while at < n:
        m = _XML_TOKEN.match(text, at)
        if m is None or m.end() > stop:
            out.add("error", at, at + 1)
            break
        end, kind = m.end(), m.lastgroup
        if m["open"] is not None:
            atts = _XML_ATT.findall(m["atts"])
            if len({a for a, _ in atts}) < len(atts) or not all(_xml_refs(v, declared) for _, v in atts):
                out.add("error", at, end)
                break
            out.add(("empty\0" if m["slash"] else "open\0") + m["open"], at, end)
        elif m["close"] is not None:
            out.add("close\0" + m["close"], at, end)
        elif kind == "text":
            s = m.group()
            if "]]>" in s or "&" in s and not _xml_refs(s, declared):
                out.add("error", at, end)
                break
            out.add("text" if s.strip(" \t\r\n") or "&" in s else "space", at, end)
        elif kind == "decl" and at != first:
            out.add("error", at, end)
            break
        else:
            if kind == "doctype":
                declared = declared | frozenset(re.findall(rf"<!ENTITY\s+({_NAME})\s", m.group()))
            out.add(kind, at, end)
        at = end
    return out
