"""What the corpus operators share: table access, name-safe columns, word and shingle hashes of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\x20\x09-\x0D"
WORD = re.compile(r"\w+")
PIECE_CHARS = 1 << 20  # texts are worked on in pieces of about so many characters, so one long text needs little memory
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null id where ids are compared; below every other id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def id_of(name: str = "doc_id") -> Column:
    """The id as bigint, null as the smallest one."""
    return F.coalesce(col(name).cast("bigint"), F.lit(NO_ID))


def held_back(id_name: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col(id_name).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Add columns computed batch by batch; of the old ones those in ``keep`` (all by default).

    An added column replaces an old one of the same name, whatever its case.
    """
    new = {name.lower() for name, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    places = [i for i, f in enumerate(df.schema.fields) if f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), *(made[n] for n, _ in added)], names=[*names, *(n for n, _ in added)]
            )

    return df.mapInArrow(run, schema)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column_of(batch, name).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_tokens(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of tokens; each distinct token is hashed once."""
    if not tokens:
        return np.empty(0, np.uint64)
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy(zero_copy_only=False)]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` tokens; fewer tokens make one window, none make none."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + len(out)]) * MIX + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mixed(out)


def grouped(texts: list[str], chars: int = PIECE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``chars`` characters together, with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def segments(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive segments, one more than there are segments."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def shingle_groups(texts: list[str], width: int = 5) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Per group of texts the place of the first, and each text's word hashes and shingle hashes (in order, repeats included).

    A text with fewer than ``width`` words has one shingle, one without words none.
    """
    for begin, some in grouped(texts):
        lists = [WORD.findall(t.lower()) for t in some]
        token = hash_tokens([w for words in lists for w in words])
        offsets = segments(np.array([len(x) for x in lists], np.int64))
        whole = windows(token, width) if len(token) >= width else np.empty(0, np.uint64)
        words, shingles = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            words.append(token[a:b])
            shingles.append(whole[a : b - width + 1] if b - a >= width else windows(token[a:b], width))
        yield begin, words, shingles
