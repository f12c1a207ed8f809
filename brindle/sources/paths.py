"""Which paths of a tree are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reference's default extensions and the directories that it leaves out.
EXTENSIONS = (".cs", ".razor", ".md")
EXCLUDED = ("bin", "obj", ".git", "node_modules", "packages", "TestResults")


def normal_path(path: Column | str) -> Column:
    """A path with ``/`` as separator and without leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def has_extension(path: Column | str, extensions: Column) -> Column:
    """Whether a path ends in one of the extensions, without regard to case; an empty list has none."""
    p = F.lower(path)
    return F.exists(extensions, lambda e: F.endswith(p, F.lower(e)))


def in_excluded(path: Column | str, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """S3: whether a segment of a path is an excluded one, without regard to case."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(x.lower()) for x in excluded)))


def indexed(files: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows of ``files`` (project, path, ...) that their project indexes: of its extensions (null: the
    default ones; empty: nothing) and in no excluded directory. Files of unknown projects and null paths
    have no row. A project's row counts once."""
    default = F.array(*map(F.lit, EXTENSIONS))
    own = projects.groupBy("project").agg(F.max(F.coalesce("extensions", default)).alias("__extensions"))
    kept = files.join(own, "project").filter(has_extension("path", F.col("__extensions")))
    return kept.filter(~in_excluded("path")).drop("__extensions")


def outside_nested(files: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``files`` that lie in no repository nested in their project. ``entries`` (project,
    path) lists what a scan saw; a directory other than the root that holds ``.git`` is nested."""
    at = F.regexp_extract("path", r"(?s)^(.+)/\.git(?:/.*)?$", 1)
    nested = entries.select("project", at.alias("__nested")).filter(F.col("__nested") != "").distinct()
    # every directory above a file against the nested ones: an equality join, as deep as the path
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = files.select("project", "path", F.explode(above).alias("__nested")).join(nested, ["project", "__nested"]).select("project", "path").distinct()
    return files.join(inside, ["project", "path"], "left_anti")
