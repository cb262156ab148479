"""Line deduplication: a line that several documents hold stays only in the first of them.

Lines are exploded as 128-bit hashes of their keys, once per document. A hash
is repeated when its smallest and largest document differ, which map-side
aggregation settles without gathering a hash's documents anywhere. The hashes a
document loses come back to it by its id, and the text is put together again in
the order of its lines.

Defined cases: a null or empty text is one empty line; keys under ``min_chars``
code points are never dropped; a null doc_id is one document that comes before
all others; rows that repeat a doc_id are one document, each keeps its rows; an
empty table gives an empty table; of extra columns only those named like an
added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import col, column_of, id_of, map_arrow
from fieldlake.session import cut_lineage

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
_HASHES = "array<struct<h1:bigint,h2:bigint>>"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the stripped, A-Z lower-cased line; None for a key that is too short."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and sum(b & 0xC0 != 0x80 for b in key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in column_of(batch, name).cast(pa.binary()).to_pylist()]


def document_lines(docs: DataFrame, text: str = "text", id_name: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, h1, h2): the line hashes of each document, each once per row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts = [], []
            for raw in _raw(batch, "t"):
                keys = {line_key(x, min_chars) for x in raw.split(b"\n")} - {None}
                digests.extend(keys)
                counts.append(len(keys))
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = np.repeat(column_of(batch, "d").to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["d", "h1", "h2"]
            )

    source = docs.select(id_of(id_name).alias("d"), col(text).cast("string").alias("t"))
    return source.mapInArrow(explode, "d bigint, h1 bigint, h2 bigint")


def dedup_lines(docs: DataFrame, text: str = "text", id_name: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with shortened texts, and n_lines (before) and n_dropped per row."""
    lines = cut_lineage(document_lines(docs, text, id_name, min_chars))
    repeated = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")).filter("first < last").drop("last")
    repeated = cut_lineage(repeated)  # so that the join gets a shuffle of its own, whose hot hashes can be split
    lost = (
        lines.join(repeated, ["h1", "h2"]).filter("d > first").groupBy("d").agg(F.collect_set(F.struct("h1", "h2")).alias("_lost"))
    )
    lost = lost.select(F.col("d").alias("_d"), "_lost")
    rows = docs.drop("_d", "_lost")
    rows = rows.join(lost, id_of(id_name) == F.col("_d"), "left").drop("_d")

    def rebuild(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, n_lines, n_dropped = [], [], []
        gone = column_of(batch, "_lost")
        ends, flat = gone.offsets.to_numpy(), gone.values
        pairs = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], 1)
        raw_pairs = np.ascontiguousarray(pairs.astype("<i8")).tobytes()
        for i, raw in enumerate(_raw(batch, text)):
            all_lines = raw.split(b"\n")
            n_lines.append(len(all_lines))
            kept = all_lines
            if ends[i] < ends[i + 1]:
                drop = {raw_pairs[16 * k : 16 * k + 16] for k in range(ends[i], ends[i + 1])}
                kept = [x for x in all_lines if line_key(x, min_chars) not in drop]
            n_dropped.append(len(all_lines) - len(kept))
            texts.append(b"\n".join(kept) if len(kept) < len(all_lines) else raw)
        return {
            text: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()),
            "n_dropped": pa.array(n_dropped, pa.int64()),
        }

    made = map_arrow(rows, rebuild, [(text, "string"), ("n_lines", "bigint"), ("n_dropped", "bigint")])
    return made.select(*(col(c) for c in docs.drop("n_lines", "n_dropped", "_d", "_lost").columns), "n_lines", "n_dropped")
