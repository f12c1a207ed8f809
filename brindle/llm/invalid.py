"""Problem 1: source files that do not parse.

Every text is turned into tokens of the language that its path's extension names and parsed with
derivatives (``derivative.py``). An empty derivative gives the failing token, a language that isn't
nullable at the end gives a truncation. What the derivatives reject is rejected. What they accept in
Python, JSON and XML is then looked at by the exact parsers of Python's library, for rules beyond the
grammars (a target that can't be assigned to, a null byte); on the test data both always agree. Texts never
leave the scan's tasks: only verdicts are shuffled.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexers
from . import grammars
from .derivative import Grammar, Node

#: Extension (lower case) -> language.
LANGUAGES = {"cs": "csharp", "py": "python", "json": "json", "csproj": "xml", "md": "markdown"}
#: Nodes after which a process builds its automaton anew, so that strange texts can't fill memory.
MAX_NODES = 300_000

#: A token that is open to the end of its text: comments and strings that nothing closes, unfinished tags.
_OPEN = {
    "csharp": re.compile(r"""/\*(?!.*\*/)|[@$]*"(?:[^\n]*\Z|"")|[@$]+"|'[^\n]*\Z""", re.S),
    "python": re.compile(r"""[A-Za-z]{0,2}(?:\"{3}|'{3}|["'][^\n]*\Z)"""),
    "json": re.compile(r'\s*"[^\n]*\Z'),
    "xml": re.compile(r"<!--(?!.*-->)|<!\[CDATA\[(?!.*\]\]>)|<[^>]*\Z", re.S),
}

_LEXERS: dict[str, Callable[[str], lexers.Tokens]] = {"csharp": lexers.lex_csharp, "python": lexers.lex_python, "json": lexers.lex_json, "xml": lexers.lex_xml}
_GRAMMARS: dict[str, Callable[[], tuple[Grammar, Node]]] = {"csharp": grammars.csharp, "python": grammars.python, "json": grammars.json, "xml": grammars.xml}
_built: dict[str, tuple[Grammar, Node]] = {}


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, None if there is none or it is unknown."""
    if path is None or "." not in path.rsplit("/", 1)[-1]:
        return None
    return LANGUAGES.get(path.rsplit(".", 1)[1].lower())


def _no_constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity aren't JSON


def _exact(language: str, text: str) -> bool | None:
    """Whether the text is valid by an exact parser; None where there is none or it gave up (too deep)."""
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.encode())
        elif language == "json":
            json.loads(text, parse_constant=_no_constant)
        elif language == "xml":
            p = expat.ParserCreate("utf-8")
            p.Parse(text.encode(), True)
        else:
            return None
    except (SyntaxError, ValueError, expat.ExpatError):
        return False
    except (RecursionError, MemoryError):
        return None
    return True


def verdict(language: str | None, text: str | None) -> tuple[str, int]:
    """('ok' | 'token' | 'end' | 'unknown', offset). 'token': the token at the offset can't stand there
    (offset 0 if only the exact parser rejects the text); 'end': the text stops too early, in the middle of
    a token or before one that must follow; 'unknown': null text or unknown language. Markdown is always
    'ok', and so is an empty text of C# or Python."""
    if text is None or language is None:
        return "unknown", 0
    if language == "markdown":
        return "ok", len(text)
    return parsed(language, text)[:2]


def parsed(language: str, text: str) -> tuple[str, int, lexers.Tokens]:
    """The verdict on a text of a language that is parsed, its offset, and the tokens."""
    grammar, start = _built.get(language) or _GRAMMARS[language]()
    if grammar.size > MAX_NODES:
        grammar, start = _GRAMMARS[language]()
    _built[language] = grammar, start
    tokens = _LEXERS[language](text)
    status, at = grammar.run(start, tokens.kinds)
    if status == "ok":
        return ("token", 0, tokens) if _exact(language, text) is False else ("ok", len(text), tokens)
    if status == "token" and (begin := tokens.starts[at]) < len(text.rstrip()) and not _OPEN[language].match(text, begin):
        return status, begin, tokens
    return "end", len(text), tokens


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        status, offset, line, language = [], [], [], []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lang = language_of(path)
            s, at = verdict(lang, text)
            status.append(s)
            offset.append(at)
            head = (text or "")[:at]
            line.append(1 + head.count("\n") + head.count("\r") - head.count("\r\n"))
            language.append(lang)
        yield pa.RecordBatch.from_arrays(
            [batch.column("project"), batch.column("path"), batch.column("at"), pa.array(language, pa.string()), pa.array(status, pa.string()), pa.array(offset, pa.int64()), pa.array(line, pa.int32())],
            names=["project", "path", "at", "language", "status", "offset", "line"],
        )


def parse_files(files: DataFrame) -> DataFrame:
    """One row per (project, path): language, status, offset and line of the failure.

    ``files`` has project, path, text, ingested_at; more columns are ignored. Of repeated rows the
    one ingested last stands; of several at the same time always the same one. Null
    project or path is a value like others. Null texts have status 'unknown'. An empty table gives
    no rows.
    """
    at = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))).alias("at")
    seen = files.select("project", "path", "text", at).mapInArrow(
        _batches, "project string, path string, at bigint, language string, status string, offset bigint, line int"
    )
    last = F.max_by(F.struct("language", "status", "offset", "line"), F.struct("at", "status")).alias("v")
    return seen.groupBy("project", "path").agg(last).select("project", "path", "v.*")


def invalid_files(files: DataFrame) -> DataFrame:
    """(project, path) of the files that are not valid."""
    return parse_files(files).filter(F.col("status").isin("token", "end")).select("project", "path")


def invalid_rates(files: DataFrame) -> DataFrame:
    """Per project and language: files, invalid and truncated files, and the share of invalid ones
    of those with a text (null if none has one)."""
    known = F.col("status") != "unknown"
    bad = F.col("status").isin("token", "end")
    return (
        parse_files(files)
        .groupBy("project", "language")
        .agg(
            F.count("*").alias("files"),
            F.count_if(bad).alias("invalid"),
            F.count_if(F.col("status") == "end").alias("truncated"),
            F.try_divide(F.count_if(bad), F.count_if(known)).alias("invalid_share"),
        )
    )
