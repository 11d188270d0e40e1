"""Line dedup: drop lines that many documents hold, keep them in one."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.llm.text import key_of, pieces, schema_with, stage, texts_of, with_columns, without

MIN_CHARS = 20
MIN_DOCS = 3


def _line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the normalised line, or nothing for a line too short to count."""
    key = line.strip().lower()  # on bytes both know ASCII only: [\x20\x09-\x0D] and A-Z
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and distinct counted line: ``(id, line)``."""

    def explode(batches):
        for batch in pieces(batches):
            ids, lines = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                found = {h for x in text.split(b"\n") if (h := _line_hash(x, min_chars))}
                ids += [doc] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.binary())], ["id", "line"])

    return docs.select(key_of(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(explode, "id long, line binary")


def dedupe_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Documents with widespread lines dropped, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points in at least ``min_docs`` distinct ids loses all its lines except in the
    largest id holding it, where every occurrence stays. A null or empty text is one empty line and comes
    back empty. Rows sharing an id are one document when counting, and each is cleaned; a null id counts
    as the smallest one. Columns named like the two results are replaced; all others are kept.
    """
    docs = without(docs, "n_lines", "n_dropped")
    lines = stage(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    holders = lines.groupBy("line").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
    # Written before the join, so that adaptive execution can split the rows of a hot line.
    holders = stage(holders.filter(F.col("n") >= min_docs).select("line", "keeper"), "line-holders")
    drops = (
        lines.join(holders, "line")
        .filter(F.col("id") != F.col("keeper"))
        .groupBy(F.col("id").alias("__id"))
        .agg(F.collect_set("line").alias("__drop"))
    )
    joined = docs.withColumn("__id", key_of(id_col)).join(drops, "__id", "left")

    def reassemble(batches):
        for batch in pieces(batches):
            kept, n_lines, n_dropped = [], [], []
            drop_lists = batch.column(batch.schema.get_field_index("__drop")).to_pylist()
            for text, drop in zip(texts_of(batch, text_col), drop_lists, strict=True):
                parts = text.split(b"\n")
                n_lines.append(len(parts))
                if drop:
                    drop = set(drop)
                    stay = [x for x in parts if _line_hash(x, min_chars) not in drop]
                else:
                    stay = parts
                kept.append(b"\n".join(stay))
                n_dropped.append(len(parts) - len(stay))
            yield with_columns(
                batch,
                ("__id", "__drop"),
                **{text_col: pa.array(kept, pa.binary()).cast(pa.string())},
                n_lines=pa.array(n_lines, pa.int64()),
                n_dropped=pa.array(n_dropped, pa.int64()),
            )

    return joined.mapInArrow(
        reassemble, schema_with(joined, ("__id", "__drop"), n_lines=T.LongType(), n_dropped=T.LongType())
    )
