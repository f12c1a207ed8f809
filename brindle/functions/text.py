"""Text of files: lines, ranges, hashes, names, markup, lengths. Built-in expressions only, no UDF.

A null text gives null everywhere, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the property White_Space, as a class for regular expressions.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unified(text: Column | str) -> Column:
    """A text whose lines end in LF, without the last one's terminator."""
    return F.regexp_replace(F.regexp_replace(_column(text), "\r\n?", "\n"), r"\n\z", "")


def lines(text: Column | str) -> Column:
    """The lines of a text. CRLF and CR count as LF; an empty text has none; one final terminator
    begins no line."""
    t = _column(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(unified(t), "\n", -1))


def line_range(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start to end (1-based, inclusive), clamped to the text's, joined with LF; empty if there
    are none."""
    first, last = F.greatest(_column(start), F.lit(1)), _column(end)
    return F.array_join(F.slice(lines(text), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def content_hash(text: Column | str) -> Column:
    """SHA-256 in lower-case hex of the lines joined with LF, so that neither kinds of line ends nor a
    final one matter."""
    return F.sha2(unified(text), 256)


def leaf(symbol: Column | str) -> Column:
    """T4: a symbol's last name."""
    return F.substring_index(_column(symbol), ".", -1)


def directory(path: Column | str) -> Column:
    """T5: what lies before a path's last slash, else an empty text."""
    return F.regexp_extract(_column(path), r"(?s)^(.*)/[^/]*$", 1)


def stripped(text: Column | str) -> Column:
    """C15's last step: a text without tags, its white space collapsed and trimmed. Markup needn't be
    well-formed."""
    spaced = F.regexp_replace(F.regexp_replace(_column(text), "<[^>]*>", " "), SPACE + "+", " ")
    return F.trim(spaced)


def utf16_units(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(_column(text), "UTF-16BE")) / 2).cast("int")


def truncated(text: Column | str, units: int) -> Column:
    """C17: the first ``units`` UTF-16 units of a text, one less where a pair would be cut in two."""
    if units < 0:
        raise ValueError("units must not be negative")
    t = _column(text)
    head = F.substring(F.encode(F.substring(t, 1, units), "UTF-16BE"), 1, 2 * units)  # no more code points than units
    high = F.hex(F.substring(head, 2 * units - 1, 1)).between("D8", "DB")
    cut = F.when(high, F.substring(head, 1, 2 * units - 2)).otherwise(head)
    # most texts are short enough as they are
    return F.when(F.length(t) * 2 <= units, t).otherwise(F.decode(cut, "UTF-16BE")) if units else F.substring(t, 1, 0)


def embed_text(path: Column | str, symbol: Column | str, kind: Column | str, body: Column | str, signature: Column | None = None, doc: Column | None = None, units: int = 2000) -> Column:
    """What is embedded for a chunk. With a signature, it has a line; so has a doc that is
    neither null nor empty. Null names are empty; a null kind is ``Unknown``; the body is truncated."""
    empty = F.lit("")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, empty), F.lit("\n"))
    parts = [line("File", _column(path)), line("Symbol", _column(symbol)), line("Kind", F.coalesce(_column(kind), F.lit("Unknown")))]
    if signature is not None:
        parts.append(line("Signature", signature))
    if doc is not None:
        parts.append(F.when(F.coalesce(doc, empty) != "", line("Doc", doc)).otherwise(empty))
    return F.concat(*parts, F.lit("Code:\n"), F.coalesce(truncated(body, units), empty))
