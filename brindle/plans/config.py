"""The configuration: JSON, overridden by environment variables."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..sources.paths import EXTENSIONS

# The reference's defaults.
FLOOR, DIMENSIONS, MAX_OVERLAYS, OVERLAY_FILES = 0.55, 1024, 8, 10
#: Environment variables begin with this; a double underscore separates levels.
PREFIX = "BRINDLE__"


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class Project:
    id: str
    root: str
    cache: str | None = None
    extensions: tuple[str, ...] = EXTENSIONS

    def validate(self) -> None:
        if not self.id.strip():
            raise ConfigError("a project's id must not be blank")
        if re.search(r"[\\/\x00-\x1f]", self.id) or self.id in (".", ".."):
            raise ConfigError(f"the id {self.id!r} can't name a folder")
        for e in self.extensions:
            if not e.startswith(".") or len(e) < 2:
                raise ConfigError(f"an extension of {self.id} must begin with a dot: {e!r}")


@dataclass(frozen=True)
class Config:
    projects: tuple[Project, ...] = ()
    model: str = "hash"
    endpoint: str = ""
    dimensions: int = DIMENSIONS
    query_prefix: str = ""
    floor: float = FLOOR
    overlays: bool = True
    max_overlays: int = MAX_OVERLAYS
    overlay_files: int = OVERLAY_FILES
    cache_root: str = field(default="")

    def validate(self) -> Config:
        seen: set[str] = set()
        for p in self.projects:
            p.validate()
            if p.id.lower() in seen:  # folders may ignore case
                raise ConfigError(f"two projects have the id {p.id}")
            seen.add(p.id.lower())
        for name in ("dimensions", "max_overlays", "overlay_files"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be positive")
        if not -1 <= self.floor <= 1:
            raise ConfigError("floor must be a cosine")
        return self

    def cache_of(self, project: Project) -> str:
        at = project.cache or (f"{self.cache_root.rstrip('/')}/{project.id}" if self.cache_root else "")
        if not at:
            raise ConfigError(f"{project.id} has no cache: set its own, or cache_root")
        return at


def _set(doc: dict, keys: list[str], value: str) -> None:
    """Sets a value below keys; a number is a place of a list, which grows by one at most."""
    at: dict | list = doc
    for k, following in zip(keys, [*keys[1:], None], strict=True):
        key: int | str = int(k) if isinstance(at, list) else k.lower()
        if isinstance(at, list) and key == len(at):
            at.append(None)
        if isinstance(at, list) and key > len(at):
            raise ConfigError(f"there is no place {key}")
        if following is None:
            at[key] = value
            return
        inner = at[key] if isinstance(at, list) else at.get(key)
        if not isinstance(inner, (dict, list)):
            at[key] = inner = [] if following.isdigit() else {}
        at = inner


def load_config(path: str | None = None, env: Mapping[str, str] = os.environ) -> Config:
    """The configuration of a JSON file, if there is one, overridden by BRINDLE__A__0__B variables."""
    doc: dict = {}
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8-sig") as f:
                doc = json.load(f)
        except ValueError as e:
            raise ConfigError(f"{path} isn't JSON: {e}") from e
        if not isinstance(doc, dict):
            raise ConfigError(f"{path} must hold an object")
    for name in sorted(env):
        if name.startswith(PREFIX):
            _set(doc, name[len(PREFIX) :].split("__"), env[name])
    try:
        projects = tuple(Project(str(p["id"]), str(p["root"]), p.get("cache"), tuple(p.get("extensions") or ()) if "extensions" in p else EXTENSIONS) for p in doc.pop("projects", []))
        kinds = {"dimensions": int, "max_overlays": int, "overlay_files": int, "floor": float, "overlays": lambda v: v if isinstance(v, bool) else str(v).lower() in ("1", "true", "yes")}
        return Config(projects, **{k: kinds.get(k, str)(v) for k, v in doc.items()}).validate()
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"a setting is missing or unknown: {e}") from e
    except ValueError as e:
        raise e if isinstance(e, ConfigError) else ConfigError(str(e)) from e
