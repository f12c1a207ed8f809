"""Problem 8: text decoded with a wrong character encoding.

Units of documents are words with characters beyond ASCII, and single signs with the word beside them.
Every distinct unit that is common enough is garbled under every chain of encodings, and the table of
garbled forms is hash-joined with the units of the documents. A unit that is the garbled form of a much
commoner one is garbled, and so is a word that has lost characters to U+FFFD. Documents with garbled
units that they don't merely quote or speak of are found, and the originals that the table gives are
put in their place.

The way back covers what the table can't hold: for words and for runs of up to RUN characters without a
space (text of scripts without spaces), layers read from UTF-8 are taken off one after another, each by
another encoding, also below one step between two other encodings; texts of the double-byte encodings
are read anew and weighed by the pairs of characters that the corpus has.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, dropped
from ..session import written as stored

# The encodings that texts are written in and read with.
SINGLE = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "mac-cyrillic", "iso8859-5", "iso8859-2", "iso8859-15", "latin-1")
DOUBLE = ("cp932", "euc-jp", "gbk", "big5", "euc-kr")
WRITTEN = ("utf-8", *SINGLE, *DOUBLE)
#: A garbled unit's original must be in this many times as many documents.
RATIO = 3
#: Most garbled units of a text that merely speaks of them, and how near their originals stand then.
SPOKEN, NEAR = 2, 80


def _charmap(encoding: str) -> list[str]:
    """The character of each byte; bytes that an encoding lacks are read as controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_READ = {e: _charmap(e) for e in SINGLE}
_WRITE = {e: {c: b for b, c in reversed(list(enumerate(m)))} for e, m in _READ.items()}


def written(text: str, encoding: str) -> bytes | None:
    """The bytes of a text, None if the encoding can't express it."""
    if encoding in _WRITE:
        m = _WRITE[encoding]
        try:
            return bytes([m[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def read(data: bytes, encoding: str) -> str:
    """Bytes read with an encoding; those that it can't read become U+FFFD."""
    m = _READ.get(encoding)
    return "".join([m[b] for b in data]) if m else data.decode(encoding, "replace")


def chains() -> list[tuple[tuple[str, str], ...]]:
    """Steps (written in, read with), once or repeatedly."""
    once = [((a, b),) for a in WRITTEN for b in (*SINGLE, *DOUBLE, "utf-8") if a != b and not (a in ("latin-1", "cp1252", "iso8859-15") and b in ("latin-1", "cp1252", "iso8859-15"))]
    twice = [(("utf-8", a), ("utf-8", b)) for a in SINGLE for b in SINGLE if a == b or {a, b} <= {"cp1252", "latin-1"}]
    thrice = [(("utf-8", a),) * 3 for a in ("cp1252", "latin-1")]
    return once + twice + thrice


CHAINS = chains()
NAMES = [" > ".join(f"{a} as {b}" for a, b in c) for c in CHAINS]
_NUMBER = {n: i for i, n in enumerate(NAMES)}


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """What becomes of a text; None if a step can't be done or nothing changes."""
    was = text
    for a, b in chain:
        data = written(text, a)
        if data is None:
            return None
        if b == "utf-8":
            # bytes that happen to be valid UTF-8 wouldn't look wrong
            text = data.decode(b, "replace")
            if "�" not in text:
                return None
        else:
            text = read(data, b)
    return text if text != was else None


def restore(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The way back; None if it isn't there."""
    for a, b in reversed(chain):
        data = written(text, b)
        if data is None:
            return None
        try:
            text = data.decode(a) if a not in _READ else read(data, a)
        except UnicodeDecodeError:
            return None
    return text


_LOST = "\ufffd"
#: Layers that are taken off, characters of a run.
LAYERS, RUN = 4, 120
_CJK = re.compile("[々぀-ヿ㐀-鿿가-힣豈-﫿]")


def _pair(a: str, b: str) -> int:
    """The number of a pair of characters; that of a single one is its code point, which is smaller."""
    return (ord(a) + 1) << 21 | ord(b)


class Known:
    """Documents that have each character (at most Unicode's) and each pair of characters (sorted numbers
    and their counts, any number of them), as far as it isn't rare."""

    def __init__(self, characters: dict[str, int], pairs: np.ndarray, counts: np.ndarray):
        self.n, self.pairs, self.counts = characters, pairs, counts

    def all_known(self, text: str) -> bool:
        """Whether every character beyond ASCII is known and there is one."""
        own = {c for c in text if c > "\x7f"}
        return bool(own) and all(self.n.get(c, 0) >= RATIO for c in own)

    def weight(self, text: str) -> float:
        """The mean binary logarithm of the documents that have a pair of the text."""
        own = np.array([_pair(a, b) for a, b in zip(text, text[1:], strict=False) if a > "\x7f" or b > "\x7f"], np.int64)
        if not len(own) or not len(self.pairs):
            return 0.0
        at = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        n = self.counts[at][self.pairs[at] == own].tolist()
        return sum(math.log2(1 + x) for x in n) / len(own)


def _loose(text: str, encoding: str) -> bytes:
    """The bytes of a text; characters that the encoding lacks become question marks."""
    m = _WRITE.get(encoding)
    return bytes([m.get(c, 63) for c in text]) if m else text.encode(encoding, "replace")


def _from_utf8(data: bytes, loosely: bool) -> str | None:
    """Bytes as UTF-8, if at most a fifth of what isn't ASCII is lost; None if nothing is gained."""
    try:
        r = data.decode()
    except UnicodeDecodeError:
        if not loosely:
            return None
        r = data.decode("utf-8", "replace")
        bad = r.count(_LOST)
        good = sum(c > "\x7f" for c in r) - bad
        if bad * 4 > good or good < 3:
            return None
        r = r.replace(_LOST, "")
    return r if not r.isascii() else None


def peeled(text: str, known: Known, loosely: bool) -> str | None:
    """What a text was before it was once or repeatedly written in UTF-8 and read otherwise, if all of
    its characters are known then."""
    best, layer = None, {text}
    for _ in range(LAYERS):
        below = {r for t in layer for x in (*SINGLE, *DOUBLE) if (data := _loose(t, x) if loosely else written(t, x)) and (r := _from_utf8(data, loosely)) and len(r) < len(t)}
        good = sorted(r for r in below if known.all_known(r))
        if good:
            best = max(good, key=known.weight)
        layer = below
        if not layer:
            break
    return best


def read_anew(text: str, known: Known) -> str | None:
    """What a run was before a step between two encodings, and what lay below that."""
    if sum(c > "\x7f" for c in text) < 4:
        return None
    seen: set[bytes] = set()
    for b in SINGLE:  # one step between single-byte encodings above a layer of UTF-8
        data = written(text, b)
        for a in SINGLE if data else ():
            t = read(data, a)
            for x in SINGLE:
                inner = written(t, x)
                if inner is not None and inner not in seen:
                    seen.add(inner)
                    r = _from_utf8(inner, False)
                    if r and len(t) - len(r) > 1 and (r := peeled(r, known, False) or r) and known.all_known(r):
                        return r
    best, least = None, known.weight(text) + math.log2(RATIO)
    for b in (*SINGLE, *DOUBLE, "utf-8"):
        data = _loose(text, b)
        for a in DOUBLE:
            for skip in (0, 1) if a != b else ():
                r = data[skip:].decode(a, "replace")
                bad = r.count(_LOST)
                r = r.replace(_LOST, "")
                n = len(_CJK.findall(r))
                if n >= max(2, 4 * bad) and known.weight(r) > least + (n < 3):
                    best, least = r, known.weight(r)
    return best


# ---- units -------------------------------------------------------------------------------------
_WORD = re.compile(r"[A-Za-z]*(?:[^\x00-\x7f]+[A-Za-z]*)+")
_WHOLE = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_RUN = re.compile(r"[^\x00-\x7f][^\x00-\x20]*")
_BESIDE = re.compile(r"[ \t]?([^\W\d_]+)")
_BESIDE_BACK = re.compile(r"([^\W\d_]+)[ \t]?$")
#: What is quoted: short spans of a line between matching signs; a string in code isn't.
_QUOTED = re.compile(r"(?P<code>[=(,\[{+] ?\"[^\"\n]*\")|`[^`\n]{1,80}`|\"[^\"\n]{1,80}\"|(?<!\w)'[^'\n]{1,80}'(?!\w)|“[^“”\n]{1,80}”|«[^«»\n]{1,80}»|„[^„“\n]{1,80}“|‘[^‘’\n]{1,80}’")


def located(text: str) -> Iterator[tuple[str, int, int]]:
    """(unit, start, end) of a text. A unit is one of: w (word), s (sign and the word after it), p (the
    word before a sign that no word follows, and it), r (run without spaces); the range is that of the
    word, sign or run."""
    for m in _RUN.finditer(text):
        for a in range(m.start(), m.end(), RUN):
            b = min(a + RUN, m.end())
            if sum(c > "\x7f" for c in text[a:b]) >= 4 and not _WHOLE.fullmatch(text, a, b):
                yield "r" + text[a:b], a, b
    for m in _WORD.finditer(text):
        w, a, b = m.group(), m.start(), m.end()
        if len(w) > 1:
            yield "w" + w, a, b
            continue
        after = _BESIDE.match(text, b)
        before = _BESIDE_BACK.search(text, max(0, a - 40), a)
        if after:
            yield "s" + w + " " + after[1], a, b
        elif before:
            yield "p" + before[1] + " " + w, a, b


def _is_word(text: str) -> bool:
    """Whether a text is one word; in linear time, which _WORD.fullmatch isn't."""
    return not text.isascii() and bool(_WHOLE.fullmatch(text))


def forms(unit: str) -> list[tuple[str, int]]:
    """(garbled unit, chain) of a clean unit."""
    kind, text = unit[0], unit[1:]
    out = []
    for k, chain in enumerate(CHAINS):
        if kind == "w":
            g = garble(text, chain)
            if g is not None and len(g) > 1 and _is_word(g):
                out.append(("w" + g, k))
        else:
            sign = text[0] if kind == "s" else text[-1]
            g = garble(sign, chain)
            if g is None or len(g) > 1 and not g.strip(_LOST) or not _is_word(g):
                continue
            if len(g) == 1:
                out.append((kind + (g + text[1:] if kind == "s" else text[:-1] + g), k))
            else:
                out.append(("w" + g, k))
    return out


def _shown(unit: str) -> str:
    """The word or sign of a unit."""
    return unit[1:] if unit[0] in "wr" else unit[1] if unit[0] == "s" else unit[-1]


def lost(unit: str) -> bool:
    """Whether characters of a word are lost: U+FFFD beside others or repeated, not alone."""
    return unit[0] == "w" and _LOST in unit


def judged(text: str, originals: dict[str, str | None]) -> str | None:
    """The text with its garbled units replaced by their originals, as far as these are known; None if
    it merely quotes or speaks of garbled units, or has none. originals: garbled unit -> original."""
    quoted = [m.span() for m in _QUOTED.finditer(text) if not m["code"]]
    hits: dict[tuple[int, int], str | None] = {}
    for unit, a, b in located(text):
        if unit in originals and hits.get((a, b)) is None:
            hits[a, b] = originals[unit]
    plain = 0
    for (a, b), original in hits.items():
        k = bisect_right(quoted, (a, len(text))) - 1
        end = a + 1 + max(i for i, c in enumerate(text[a:b]) if c > "\x7f")
        if k >= 0 and quoted[k][0] < a and end < quoted[k][1]:
            continue
        around = text[max(0, a - NEAR) : a] + "\n" + text[b : b + NEAR]
        if original is not None and len(original) > 1 and len(hits) <= SPOKEN and original in around:
            continue
        plain += 1
    if not plain:
        return None
    out, at = [], 0
    for (a, b), original in sorted(hits.items(), key=lambda h: (h[0][0], -h[0][1] * (h[1] is not None))):
        if a >= at:
            out += [text[at:a], text[a:b] if original is None else original]
            at = b
    return "".join([*out, text[at:]])


# ---- the operator ------------------------------------------------------------------------------
def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct units of every document."""
    for batch in batches:
        ids, units = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {u for u, _, _ in located(text)} if text and not text.isascii() else ()
            ids += [doc] * len(own)
            units += own
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.string())], names=["doc_id", "unit"])


def _form_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str, int]] = []
        for unit, n in zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if unit[0] != "r" and not lost(unit):
                rows += {(g, _shown(unit), n) for g, _ in forms(unit) if _LOST not in g or len(g.strip(_LOST)) > 3}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["unit", "original", "of"])


def _lost_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [u for u in batch.column("unit").to_pylist() if lost(u)]
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.nulls(len(units), pa.string()), pa.array([0] * len(units), pa.int64())], names=["unit", "original", "of"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the characters and pairs beyond ASCII with the documents of the units that have them."""
    count: dict[int, int] = {}
    for batch in batches:
        for unit, n in zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True):
            t = _shown(unit)
            for x in {*t, *(t[i : i + 2] for i in range(len(t) - 1))}:
                if not x.isascii():
                    k = _pair(*x) if len(x) == 2 else ord(x)
                    count[k] = count.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], names=["pair", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("pair", "n")], names=["pairs", "counts"])


def _shared_pairs(pairs: DataFrame) -> list[str]:
    """Names of two files that every executor gets, of the sorted pairs and of their counts. The driver
    writes them from a partition at a time; workers map them instead of loading them, so the number of
    pairs needs no limit."""
    folder = tempfile.mkdtemp(prefix="brindle-")
    paths = [os.path.join(folder, f"{os.path.basename(folder)}-{c}") for c in ("pairs", "counts")]
    with open(paths[0], "wb") as f, open(paths[1], "wb") as g:
        for r in pairs.orderBy("pair").mapInArrow(_packed, "pairs binary, counts binary").toLocalIterator():
            f.write(r.pairs)
            g.write(r.counts)
    for path in paths:
        pairs.sparkSession.sparkContext.addFile(path)
    return [os.path.basename(p) for p in paths]


def _mapped(name: str) -> np.ndarray:
    path = SparkFiles.get(name)
    return np.memmap(path, "<i8", "r") if os.path.getsize(path) else np.zeros(0, np.int64)


_HIT = "unit string, original string, of bigint"


def garbled_units(counted: DataFrame) -> DataFrame:
    """unit, original (null if it is lost) of the units (unit, n: documents that have it) that are
    garbled; of several originals the one in most documents."""
    # by its own number of partitions, so that few bytes of units aren't taken together: each is much work
    spread = max(12, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = counted.filter(F.col("n") >= RATIO).repartition(spread, "unit").mapInArrow(_form_rows, _HIT)
    known = table.join(counted, "unit").filter(F.col("of") >= RATIO * F.col("n")).select("unit", "original", "of")
    known_forms = known = checkpointed(known)
    # an original that is itself garbled is none
    known = known.join(known.select(F.col("unit").alias("bad")).distinct(), F.concat(F.lit("w"), "original") == F.col("bad"), "left_anti")
    pairs = stored(counted.mapInArrow(_pair_rows, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= RATIO))
    single = F.col("pair") < _pair("\0", "\0")
    shared = counted.sparkSession.sparkContext.broadcast({chr(r.pair): r.n for r in pairs.filter(single).collect()})  # at most Unicode's characters
    files = _shared_pairs(pairs.filter(~single))
    dropped(pairs)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Known(shared.value, *map(_mapped, files))
        for batch in batches:
            rows = []
            for unit in batch.column("unit").to_pylist():
                t = _shown(unit)
                if unit[0] in "wr":
                    r = peeled(t, k, False) or (peeled(t, k, True) if len(t) > 5 else None) or read_anew(t, k)
                    if r is not None and r != t:
                        rows.append((unit, r))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([r for _, r in rows], pa.string()), pa.array([1] * len(rows), pa.int64())], names=["unit", "original", "of"])

    layers = counted.repartition(spread, "unit").mapInArrow(back, _HIT)
    # what is left may be a form in the table
    deeper = known_forms.select(F.col("unit").alias("form"), F.col("original").alias("first"), F.col("of").alias("first_of"))
    last = layers.join(deeper, F.concat(F.lit("w"), "original") == F.col("form"), "left").select("unit", F.coalesce("first", "original").alias("original"), F.coalesce("first_of", "of").alias("of"))
    hits = known.unionByName(last).unionByName(counted.mapInArrow(_lost_rows, _HIT))
    return hits.groupBy("unit").agg(F.max_by("original", F.struct("of", "original")).alias("original"))


def _judged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for r in batch.to_pylist():
            restored = judged(r["text"], {h["unit"]: h["original"] for h in r["hits"]})
            if restored is not None:
                ids.append(r["doc_id"])
                texts.append(restored)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "restored"])


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id and restored of the documents (doc_id, text; more columns are ignored) that were decoded
    with a wrong encoding in whole or in part; restored has the originals in place as far as they are
    known. Null and empty texts and null ids are no cases; an empty table gives no rows."""
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    units = checkpointed(texts.mapInArrow(_unit_rows, "doc_id bigint, unit string").distinct())
    counted = units.groupBy("unit").agg(F.count("*").alias("n"))
    hits = units.join(garbled_units(checkpointed(counted)), "unit").groupBy("doc_id").agg(F.collect_list(F.struct("unit", "original")).alias("hits"))
    return texts.join(hits, "doc_id").mapInArrow(_judged_rows, "doc_id bigint, restored string")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the garbled documents."""
    return garbled(documents).select("doc_id").distinct()
