"""The tools that an agent calls, as JSON text between markers."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from functools import wraps

from ..operators.lookup import MALFORMED
from .service import Engine, ServiceError

# The kinds of chunks.
KINDS = ("Unknown", "Class", "Interface", "Struct", "Record", "Enum", "Method", "Constructor", "Property", "Field", "FileFragment")
_ESCAPES = str.maketrans({"&": "&amp;", '"': "&quot;", "<": "&lt;", ">": "&gt;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})


def wrapped(content: str, origin: str) -> str:
    """Content that nobody vouches for, between markers with a random number that it doesn't contain,
    so that no text in it can end it."""
    while (nonce := secrets.token_hex(12)) in content:
        pass
    return f'<untrusted-content id="{nonce}" origin="{origin.translate(_ESCAPES)}">\n{content}\n</untrusted-content id="{nonce}">'


def bytes_text(n: int) -> str:
    """T13."""
    size, units = float(n), ["B", "KB", "MB", "GB"]
    while size >= 1024 and len(units) > 1:
        size /= 1024
        units.pop(0)
    return f"{size:.1f} {units[0]}"


def kind_of(name: str | None) -> str | None:
    """A kind by its name, whatever its case; None, which filters nothing, for others."""
    return {k.lower(): k for k in KINDS}.get((name or "").strip().lower())


def to_json(value: object) -> str:
    """Without what is null, and readable: no escapes but those that JSON needs."""
    strip = lambda x: {k: strip(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [strip(v) for v in x] if isinstance(x, list) else x
    return json.dumps(strip(value), ensure_ascii=False, separators=(",", ":"), default=str)


def hit_payload(h: dict) -> dict:
    """P7."""
    return {
        "id": f"{h['project']}:{h['generation']}:{h['chunk_id']}", "project": h["project"], "path": h["path"], "start_line": h["start_line"], "end_line": h["end_line"], "kind": h["kind"],
        "symbol": h["symbol"], "signature": h["signature"], "doc": h["doc"] or None, "excerpt": h["excerpt"], "excerpt_may_be_stale": True if h["stale"] else None, "score": h.get("score"),
    }


def _told(tool: Callable[..., str]) -> Callable[..., str]:
    """What a caller can mend is told as {"error": ...}."""

    @wraps(tool)
    def run(*args: object, **named: object) -> str:
        try:
            return tool(*args, **named)
        except (ServiceError, ValueError) as e:
            return to_json({"error": str(e)})

    return run


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine

    @_told
    def code_search(self, query: str, limit: int = 5, kind: str | None = None, path_filter: str | None = None, project: str | None = None) -> str:
        r = self.engine.search(query, limit, kind_of(kind), path_filter, project)
        return wrapped(to_json({"hits": [hit_payload(h) for h in r.hits], "embeddings_unavailable": r.degraded or None, "warning": " ".join(r.warnings) or None}), project or "all projects")

    @_told
    def code_get_chunk(self, id: str) -> str:
        project, _, rest = id.rpartition(":")
        project, _, generation = project.rpartition(":")
        digits = [x.isascii() and x.isdigit() and int(x) < 2**31 for x in (generation, rest)]
        if not project or not all(digits):
            raise ServiceError(f"{MALFORMED} id: it must be project:generation:chunk")
        h = self.engine.of(project).chunk(int(generation), int(rest))
        if h is None:
            raise ServiceError("there is no such chunk")
        return wrapped(to_json(hit_payload(h)), f"{project}/{h['path']}")

    @_told
    def code_index_status(self, project: str | None = None) -> str:
        return self._each(project, lambda own: own.status())

    @_told
    def code_reindex(self, project: str | None = None) -> str:
        return self._each(project, lambda own: own.rebuild() and own.status())

    def _each(self, project: str | None, do: Callable[..., dict]) -> str:
        """One project, whose failure is an error, or all, each with its own failure beside the others."""
        if project is not None:
            return to_json(do(self.engine.of(project)))
        out = []
        for name, own in self.engine.indexes.items():
            try:
                out.append(do(own))
            except Exception as e:
                out.append({"project": name, "error": str(e)})
        return to_json({"projects": out})
