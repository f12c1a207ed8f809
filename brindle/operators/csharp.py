"""C# files into chunks by declaration.

A tolerant scanner over the tokens: it looks for declarations only, skips bodies by their brackets, and goes
on behind what it can't read. Files without any declaration, and those it fails on, become line windows
(C1), as do files in other languages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.lexers import CS_CONTEXTUAL, Tokens, lex_csharp
from .chunking import FRAGMENT, OVERLAP, WINDOW

# Words of C# that stand before a declaration or name a type.
_MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly extern unsafe volatile new const fixed async partial required file".split())
_PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_PARAMETER = frozenset("ref out in params this scoped readonly".split())
_IDENT = frozenset(("id", *CS_CONTEXTUAL))
_KINDS = {"class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Enum", "record": "Record"}
_EOL = re.compile("\r\n|[\r\n\x85  ]")
_CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Declaration:
    kind: str  # of a chunk; "" for what has none
    names: list[str]  # one a chunk
    first: int
    last: int  # tokens, inclusive
    signatures: list[str]
    outer: tuple[str, ...] = ()
    shown: list[str] = field(default_factory=list)  # names in the list of its type's members
    members: list[Declaration] = field(default_factory=list)
    is_type: bool = False
    is_delegate: bool = False


class Scanner:
    def __init__(self, tokens: Tokens, text: str):
        self.k, self.starts, self.ends, self.trivia, self.text = [*tokens.kinds, ""], tokens.starts, tokens.ends, tokens.trivia, text
        self.n = len(tokens.kinds)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, k in enumerate(tokens.kinds):
            if k in _CLOSING:
                stack.append(i)
            elif k in (")", "]", "}"):
                while stack and _CLOSING[self.k[stack[-1]]] != k:
                    stack.pop()
                if stack:
                    self.close[stack.pop()] = i

    def source(self, a: int, b: int) -> str:
        """The text of tokens a up to b, exclusive."""
        return self.text[self.starts[a] : self.ends[b - 1]] if a < b else ""

    def after(self, i: int) -> int:
        """Behind a bracket's other side; the end if it is open."""
        return self.close.get(i, self.n - 1) + 1

    def skip(self, i: int, end: int, stops: str) -> int:
        """The first token from i that is one of the stops, brackets passed over."""
        while i < end and self.k[i] not in stops.split():
            i = self.after(i) if self.k[i] in _CLOSING else i + 1
        return min(i, end)

    # -- parts ----------------------------------------------------------------------------------
    def type_args(self, i: int) -> int:
        """Behind <...> at i, or i if there is none."""
        if self.k[i] != "<":
            return i
        depth, j = 0, i
        while j < self.n:
            k = self.k[j]
            if k == "<":
                depth += 1
            elif k == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif k in ("(", "["):
                j = self.after(j)
                continue
            elif k not in _IDENT and k not in _PREDEFINED and k not in (",", ".", "::", "?", "*", "in", "out", "ref", "readonly", "delegate"):
                return i
            j += 1
        return i

    def type_end(self, i: int) -> int:
        """Behind the type at i, or -1."""
        while self.k[i] in ("ref", "readonly", "scoped") and self.k[i + 1] not in (",", ")", ";", "=", "("):
            i += 1
        if self.k[i] == "delegate" and self.k[i + 1] == "*":
            i += 2
            if self.k[i] in ("managed", "unmanaged"):
                i += 1
            if self.k[i] == "[":
                i = self.after(i)
            j = self.type_args(i)
            if j == i:
                return -1
            i = j
        elif self.k[i] == "(":
            i = self.after(i)
        elif self.k[i] in _PREDEFINED:
            i += 1
        elif self.k[i] in _IDENT:
            i += 1
            if self.k[i] == "::":
                i += 2
            i = self.type_args(i)
            while self.k[i] == "." and self.k[i + 1] in _IDENT:
                i = self.type_args(i + 2)
        else:
            return -1
        while self.k[i] in ("?", "*", "["):
            i = self.after(i) if self.k[i] == "[" else i + 1
        return i

    def name_of(self, i: int) -> str:
        return self.source(i, i + 1)

    def parameters(self, i: int) -> str:
        """The parameter list that opens at i, without attributes and default values."""
        end, out, j = self.after(i) - 1, [], i + 1
        while j < end:
            stop = j
            while stop < end and self.k[stop] != ",":
                stop = self.after(stop) if self.k[stop] in _CLOSING else (self.type_args(stop) if self.type_args(stop) > stop else stop + 1)
            while j < stop and self.k[j] == "[":
                j = self.after(j)
            words = []
            while j < stop and self.k[j] in _PARAMETER:
                words.append(self.name_of(j))
                j += 1
            t = self.type_end(j) if j < stop else -1
            if 0 < t < stop and self.k[t] in _IDENT:
                out.append(" ".join([*words, f"{self.source(j, t)} {self.name_of(t)}"]))
            elif j < stop or words:
                out.append(" ".join([*words, self.source(j, self.skip(j, stop, "="))]))
            j = stop + 1
        return ", ".join(out)

    def body_end(self, i: int, end: int) -> int:
        """The last token of a declaration whose head ends at i: a body, an expression or a semicolon."""
        i = self.skip_head(i, end)
        if i >= end:
            return end - 1
        return self.after(i) - 1 if self.k[i] == "{" else min(self.skip(i, end, ";"), end - 1)

    def skip_head(self, i: int, end: int) -> int:
        while i < end and self.k[i] not in ("{", "=>", ";"):
            i = self.after(i) if self.k[i] in ("(", "[") else i + 1
        return i

    # -- declarations ---------------------------------------------------------------------------
    def scan(self) -> list[Declaration]:
        return self.block(0, self.n, (), False)

    def block(self, i: int, end: int, outer: tuple[str, ...], in_type: bool) -> list[Declaration]:
        out: list[Declaration] = []
        while i < end:
            if not in_type and self.k[i] == "namespace":
                stop = i + 1
                while stop < end and self.k[stop] not in ("{", ";"):
                    stop += 1
                inner = (*outer, "".join(self.name_of(x) for x in range(i + 1, stop)))
                if stop < end and self.k[stop] == "{":
                    out += self.block(stop + 1, self.after(stop) - 1, inner, False)
                    i = self.after(stop)
                else:
                    return out + self.block(stop + 1, end, inner, False)
                continue
            if not in_type and (self.k[i] in ("using", "extern") or self.k[i] == "global" and self.k[i + 1] == "using"):
                i = self.skip(i, end, ";") + 1
                continue
            d, j = self.declaration(i, end, outer, in_type)
            if d is not None:
                out.append(d)
            i = max(j, i + 1)
        return out

    def declaration(self, i: int, end: int, outer: tuple[str, ...], in_type: bool) -> tuple[Declaration | None, int]:
        first = i
        while i < end and self.k[i] == "[":
            i = self.after(i)
        mods: list[str] = []
        while i < end and (self.k[i] in _MODIFIERS and (self.k[i] not in _IDENT or self.k[i + 1] in _IDENT | _PREDEFINED | _MODIFIERS | {"class", "struct", "interface", "enum", "delegate", "event", "ref"}) or self.k[i] == "ref" and self.k[i + 1] in ("struct", "partial")):
            mods.append(self.k[i])
            i += 1
        if i >= end:
            return None, end
        head, k = " ".join(mods) + " " * bool(mods), self.k[i]
        made = lambda kind, names, signatures, last, **more: (Declaration(kind, names, first, last, signatures, outer, **({"shown": names} | more)), last + 1)

        if k in ("class", "struct", "interface", "enum") or k == "record" and self.k[i + 1] in _IDENT | {"class", "struct"}:
            word = k
            if k == "record" and self.k[i + 1] in ("class", "struct"):
                i += 1
                word = f"record {self.k[i]}"
            name, i = self.name_of(i + 1), i + 2
            args = self.type_args(i) if k != "enum" else i
            signature = f"{head}{word} {name}{self.source(i, args)}"
            return self.type_body(args, end, first, _KINDS[k], name, signature, outer, k == "enum")
        if k == "id" and in_type and self.name_of(i) == "extension" and self.k[i + 1] in ("(", "<"):
            return self.type_body(self.type_args(i + 1), end, first, "", "", "", outer, False)
        if k == "delegate" and self.k[i + 1] != "*":
            t = self.type_end(i + 1)
            if t > 0 and self.k[t] in _IDENT:
                args = self.type_args(t + 1)
                if self.k[args] == "(":
                    name = self.name_of(t)
                    signature = f"{head}delegate {self.source(i + 1, t)} {name}{self.source(t + 1, args)}({self.parameters(args)})"
                    return made("Method", [name], [signature], min(self.skip(args, end, ";"), end - 1), is_delegate=True)
        if not in_type:
            return None, self.behind(i, end)
        if k == "event":
            t = self.type_end(i + 1)
            if t < 0:
                return None, self.behind(i, end)
            return self.variables(t, end, first, f"{head}event {self.source(i + 1, t)}", outer, True)
        if k in ("implicit", "explicit"):
            i = self.skip(i, end, "operator") + 1
            i += self.k[i] == "checked"
            t = self.type_end(i)
            if t < 0 or self.k[t] != "(":
                return None, self.behind(i, end)
            name = f"{k} operator {self.source(i, t)}"
            return made("Method", [name], [f"{head}{name}({self.parameters(t)})"], self.body_end(self.after(t), end))
        if k in _IDENT and self.k[i + 1] == "(":
            name = self.name_of(i)
            return made("Constructor", [name], [f"{head}{name}({self.parameters(i + 1)})"], self.body_end(self.after(i + 1), end))
        t = self.type_end(i)
        if t < 0 or t >= end:
            return None, self.behind(i, end)
        type_ = self.source(i, t)
        while self.k[t] in _IDENT and self.k[self.type_args(t + 1)] == ".":  # the interface that is implemented
            t = self.type_args(t + 1) + 1
        if self.k[t] == "operator":
            op = self.skip(t + 1, end, "(")
            symbol = "".join(self.name_of(x) for x in range(t + 1, op)).removeprefix("checked")
            return made("Method", [f"operator {symbol}"], [f"{head}{type_} operator {symbol}({self.parameters(op)})"], self.body_end(self.after(op), end))
        if self.k[t] == "this" and self.k[t + 1] == "[":
            signature = f"{head}{type_} this[{self.parameters(t + 1)}]"
            return made("Property", ["this[]"], [signature], self.property_end(self.after(t + 1), end))
        if self.k[t] not in _IDENT:
            return None, self.behind(i, end)
        name, args = self.name_of(t), self.type_args(t + 1)
        if self.k[args] == "(":
            return made("Method", [name], [f"{head}{type_} {name}{self.source(t + 1, args)}({self.parameters(args)})"], self.body_end(self.after(args), end))
        if self.k[t + 1] in ("{", "=>"):
            return made("Property", [name], [f"{head}{type_} {name}"], self.property_end(t + 1, end))
        return self.variables(t, end, first, head + type_, outer, "const" in mods or {"static", "readonly"} <= set(mods))

    def behind(self, i: int, end: int) -> int:
        """Behind what can't be read: its semicolon or its body."""
        while i < end and self.k[i] != ";":
            if self.k[i] == "{":
                return self.after(i)
            i = self.after(i) if self.k[i] in ("(", "[") else i + 1
        return i + 1

    def property_end(self, i: int, end: int) -> int:
        if i < end and self.k[i] == "{":
            last = self.after(i) - 1
            return min(self.skip(last + 1, end, ";"), end - 1) if self.k[last + 1] == "=" else last
        return min(self.skip(i, end, ";"), end - 1)

    def variables(self, i: int, end: int, first: int, signature: str, outer: tuple[str, ...], chunked: bool) -> tuple[Declaration | None, int]:
        """The variables of a field or an event, all with the owner's range."""
        names = []
        while self.k[i] in _IDENT and self.k[i + 1] == "." and i < end:
            i += 2
        if self.k[i] in _IDENT and self.k[i + 1] == "{":
            name = self.name_of(i)
            return Declaration("Field", [name], first, self.after(i + 1) - 1, [f"{signature} {name}"], outer, [name]), self.after(i + 1)
        while i < end and self.k[i] in _IDENT:
            names.append(self.name_of(i))
            i = self.skip(i + 1, end, ", ;")
            if i >= end or self.k[i] == ";":
                break
            i += 1
        if not names or i >= end or self.k[i] != ";":
            return None, self.behind(i, end)
        return Declaration("Field" if chunked else "", names, first, i, [f"{signature} {n}" for n in names], outer, names), i + 1

    def type_body(self, i: int, end: int, first: int, kind: str, name: str, signature: str, outer: tuple[str, ...], enum: bool) -> tuple[Declaration, int]:
        while i < end and self.k[i] not in ("{", ";"):
            i = self.after(i) if self.k[i] in ("(", "[") else i + 1
        d = Declaration(kind, [name], first, min(i, end - 1), [signature], outer, [name] if name else [], is_type=True)
        if i < end and self.k[i] == "{":
            close = self.close.get(i, end)
            d.last = min(close, end - 1)
            if enum:
                at = i + 1
                while at < close:
                    while at < close and self.k[at] == "[":
                        at = self.after(at)
                    if at < close and self.k[at] in _IDENT:
                        d.members.append(Declaration("", [], at, at, [], shown=[self.name_of(at)]))
                    at = self.skip(at, close, ",") + 1
            else:
                d.members = self.block(i + 1, close, (*outer, name) if name else outer, True)
        last = d.last
        if self.k[last + 1] == ";" and last + 1 < end and self.k[last] == "}":
            d.last = last = last + 1
        return d, last + 1


def clean_doc(raw: str) -> str:
    """The text of a documentation comment in one line, without markers and tags."""
    out = []
    for line in raw.replace("\r\n", "\n").split("\n"):
        s = line.strip()
        if s.endswith("*/"):
            s = s[:-2].rstrip()
        for marker in ("///", "/**", "*"):
            if s.startswith(marker):
                s = s[len(marker) :].strip()
                break
        if s:
            out.append(s)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", " ".join(out))).strip()


def truncate(text: str, units: int = 2000) -> str:
    """C17 for one text: its first UTF-16 units, no pair cut in two."""
    return text.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore") if 2 * len(text) > units else text


def embed_text(path: str, symbol: str, kind: str, body: str, signature: str | None = None, doc: str = "") -> str:
    """C4 and C16 for one chunk."""
    head = f"File: {path}\nSymbol: {symbol}\nKind: {kind}\n" + ("" if signature is None else f"Signature: {signature}\n") + (f"Doc: {doc}\n" if doc else "")
    return f"{head}Code:\n{truncate(body)}"


Chunk = tuple[int, int, str, str, str, str, str]


def structural_chunks(path: str, text: str) -> list[Chunk]:
    """(start_line, end_line, kind, symbol, signature, doc, embed_text) of a C# text: types in source
    order, each followed by its own members; delegates last (C9)."""
    tokens = lex_csharp(text)
    scan = Scanner(tokens, text)
    breaks = [m.end() for m in _EOL.finditer(text)]
    types: list[Declaration] = []
    delegates: list[Declaration] = []

    def walk(found: list[Declaration]) -> None:
        for d in found:
            if d.is_delegate:
                delegates.append(d)
            elif d.is_type:
                types.append(d)
                walk(d.members)

    walk(scan.scan())
    delegates.sort(key=lambda d: d.first)
    out: list[Chunk] = []

    def emit(d: Declaration) -> None:
        body = ", ".join(n for m in d.members for n in m.shown) if d.is_type else scan.source(d.first, d.last + 1)
        doc = _doc(tokens, d.first, text)
        a, b = (bisect_right(breaks, x) + 1 for x in (tokens.starts[d.first], max(tokens.starts[d.first], tokens.ends[d.last] - 1)))
        for name, signature in zip(d.names, d.signatures, strict=True):
            symbol = ".".join([*d.outer, name])
            out.append((a, b, d.kind, symbol, signature, doc, embed_text(path, symbol, d.kind, body, signature, doc)))

    for t in types:
        if t.names[0]:
            emit(t)
        for m in t.members:
            if m.kind and not m.is_type and not m.is_delegate:
                emit(m)
    for d in delegates:
        emit(d)
    return out


def _doc(tokens: Tokens, i: int, text: str) -> str:
    """The first documentation comment before a token; lines that follow each other are one."""
    run: list[str] = []
    last = 0
    for start, end, is_doc in tokens.trivia.get(i, ()):
        if is_doc and (not run or len(_EOL.findall(text[last:start])) <= 1):
            run.append(text[start:end])
            last = end
        elif run:
            break
    return clean_doc("\n".join(run))


def window_chunks(path: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[Chunk]:
    """The line windows of a text, as ``chunking.line_windows`` has them."""
    unified = re.sub("\r\n?", "\n", text)
    lines = unified.removesuffix("\n").split("\n") if text else []
    out: list[Chunk] = []
    for a in range(1, len(lines) + 1, window - overlap):
        b = min(a + window - 1, len(lines))
        name = f"{path}:{a}-{b}"
        out.append((a, b, FRAGMENT, name, name, "", embed_text(path, name, FRAGMENT, "\n".join(lines[a - 1 : b]))))
        if b == len(lines):
            break
    return out


def chunks_of(path: str, text: str | None) -> list[Chunk]:
    """C# by declaration; line windows where that gives nothing or fails, and for other languages."""
    if text is None:
        return []
    found: list[Chunk] = []
    if path.lower().endswith(".cs"):
        try:
            found = structural_chunks(path, text)
        except (IndexError, KeyError, ValueError, RecursionError):
            found = []
    return found or window_chunks(path, text)


_SCHEMA = pa.schema([
    ("project", pa.string()), ("path", pa.string()), ("pos_in_file", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("kind", pa.string()), ("symbol", pa.string()), ("signature", pa.string()), ("doc", pa.string()), ("embed_text", pa.string()),
])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, f, i, *c) for p, f, t in zip(*(batch.column(n).to_pylist() for n in ("project", "path", "text")), strict=True) for i, c in enumerate(chunks_of(f, t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def chunk_files(files: DataFrame) -> DataFrame:
    """Project, path, pos_in_file, start_line, end_line, kind, symbol, signature, doc, embed_text of files
    (project, path, text; more columns are ignored; a row is a file). Null and empty texts have no chunks;
    rows with a null path are left out. Nothing is shuffled."""
    kind = "project string, path string, pos_in_file int, start_line int, end_line int, kind string, symbol string, signature string, doc string, embed_text string"
    return files.dropna(subset=["path"]).select("project", "path", "text").mapInArrow(_batches, kind)
