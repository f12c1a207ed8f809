"""The queries of the problems tagged llm, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import bpe, docpairs, invalid, knn, mojibake, packing, split

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Query]:
    """Name -> query (session, folder of the tables)."""
    return {
        "p1_found": _over(invalid.invalid_files, "source_files"),
        "p1_rates": _over(invalid.invalid_rates, "source_files"),
        "p2_found": _over(knn.found, "index_vectors"),
        "p4_found": _over(docpairs.found, "source_files"),
        "p5_found": _over(split.found, "chunks", "source_files", "split_limits"),
        "p5_pieces": _over(split.split_chunks, "chunks", "source_files", "split_limits"),
        "p6_ids": _over(bpe.encode, "documents"),
        "p6_spans": _over(bpe.spans, "documents"),
        "p6_decoded": lambda spark, d: bpe.decode(bpe.encode(table(spark, d, "documents"))),
        "p7_containers": _over(packing.containers, "documents", "pack_targets"),
        "p7_rates": _over(packing.fill_rates, "documents", "pack_targets"),
        "p8_found": _over(mojibake.found, "documents"),
        "p8_restored": _over(mojibake.garbled, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """The same in SQL. Parsing, vector search, encoding and packing have none; their tests hold them
    against brute force, exact parsers or a round trip."""
    return {"p5_found": split.FOUND_SQL, "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
