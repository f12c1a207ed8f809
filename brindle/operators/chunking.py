"""Files into chunks: the current rows of a file table, line windows, embed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines of a window, lines that two windows share.
WINDOW, OVERLAP = 100, 20
FRAGMENT = "FileFragment"


def current_files(files: DataFrame) -> DataFrame:
    """project, path, text, length, mtime: the row of each file that was ingested last; at the same time
    the one of the greatest text. Rows without project or path aren't files."""
    row = F.struct("text", "length", "mtime")
    order = F.struct(F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit(0).cast("timestamp")), "text", "length", "mtime")
    return files.dropna(subset=["project", "path"]).groupBy("project", "path").agg(F.max_by(row, order).alias("__row")).select("project", "path", "__row.*")


def window_starts(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """First lines (1-based) of the windows over n lines: every ``window - overlap`` lines, up to the
    first window that reaches the end; none over no lines."""
    if window < 1 or not 0 <= overlap < window:
        raise ValueError("window must be positive and overlap less than it, not negative")
    stride = window - overlap
    more = F.ceil(F.greatest(n - window, F.lit(0)) / stride).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), more), lambda i: i * stride + 1)).otherwise(F.array().cast("array<int>"))


def line_windows(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Project, path, pos_in_file, start_line, end_line, kind, symbol, signature, doc of the
    overlapping line windows of files (project, path, text; more columns are ignored). Null and empty
    texts have none."""
    n = F.size(T.lines("text"))
    at = files.filter(F.col("text").isNotNull()).select("project", "path", n.alias("n"), F.posexplode(window_starts(n, window, overlap)).alias("pos_in_file", "start_line"))
    end = F.least(F.col("start_line") + (window - 1), F.col("n"))
    name = F.format_string("%s:%d-%d", "path", "start_line", end)
    return at.select("project", "path", "pos_in_file", "start_line", end.alias("end_line"), F.lit(FRAGMENT).alias("kind"), name.alias("symbol"), name.alias("signature"), F.lit("").alias("doc"))


def with_text(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks with the column ``body``, their lines in their file; null where the file or its text
    is missing. A chunk's own column ``body`` is replaced."""
    texts = current_files(files).select("project", "path", F.col("text").alias("__text"))
    joined = chunks.drop("body").join(texts, ["project", "path"], "left")
    return joined.withColumn("body", T.line_range("__text", "start_line", "end_line")).drop("__text")


def with_embed_text(chunks: DataFrame, files: DataFrame, units: int = 2000) -> DataFrame:
    """The chunks with the column ``embed_text``. Windows have no line for signature and doc.
    A chunk without text has an empty body."""
    window = T.embed_text("path", "symbol", "kind", "body", units=units)
    structural = T.embed_text("path", "symbol", "kind", "body", F.col("signature"), F.col("doc"), units)
    return with_text(chunks, files).withColumn("embed_text", F.when(F.col("kind") == FRAGMENT, window).otherwise(structural)).drop("body")


def kind_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks by project and kind; a chunk_id counts once."""
    return chunks.dropDuplicates(["chunk_id"]).groupBy("project", "kind").agg(F.count("*").alias("chunks"))
