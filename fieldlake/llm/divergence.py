"""Source divergence audit: how the sources of a language differ in the terms they use.

A term is a maximal run of letters (anything but ASCII marks, digits, blanks
and control characters) with A-Z lower-cased. Each language keeps the terms that
at least ``min_docs`` of its documents hold. Within a language every source, and
the language as a whole, gives each kept term a smoothed share in whole
billionths; sources are compared by the sum of absolute differences, and each
source lists the terms it uses more than its language does. All arithmetic is
in whole numbers.

Strings are materialised late. Texts are read once: each task counts its terms
and writes the counts with a 64-bit digest beside the term. Only the digests are
shuffled to count documents and occurrences. The strings are then read back for
digests that are frequent enough, as their smallest and largest: where these
are the same the digest stands for one term, where they differ it is split and
its strings are counted by themselves. Kept terms get a number, which all later
steps carry; the text is joined to the reported terms in the end.

Pairs of sources are compared in blocks of ``TERMS`` terms by ``SOURCES`` x
``SOURCES`` sources, each a matrix of bounded size in a task, so nothing is
emitted per term and pair. Terms that neither block of sources holds are
settled by one product.

Defined cases: null text, language and source are empty strings, and the empty
string is a language and a source like any other; each row is a document, also
where ids repeat; a source without kept terms, or a language without any, still
has its pairs (at the value of the smoothing alone, 0 without kept terms); an
empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import col, column_of
from fieldlake.session import cut_lineage

MIN_DOCS, TOP = 30, 50
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
PIECE_BYTES = 1 << 23
HELD_ROWS = 1 << 19  # counts a task holds before it passes them on
FILTER_BITS = 24  # of the filter over kept digests: at most 2^18 rows of 64 bits are broadcast
TERMS, SOURCES = 8192, 128
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``PIECE_BYTES``, at least one row each."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > PIECE_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _count_piece(batch: pa.RecordBatch) -> pa.Table:
    """The counts of the rows of a batch, one row per language, source and term."""
    group = pa.StructArray.from_arrays([column_of(batch, "lang"), column_of(batch, "source")], names=["lang", "source"])
    names = pa.Table.from_struct_array(group).group_by(["lang", "source"]).aggregate([])
    at = {pair: i for i, pair in enumerate(zip(*(names.column(n).to_pylist() for n in ("lang", "source"))))}
    of = np.array([at[x["lang"], x["source"]] for x in group.to_pylist()], np.int64)
    lists = pc.split_pattern_regex(pc.ascii_lower(column_of(batch, "text")), NOT_TERM)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[code] if len(words) else np.zeros(0, bool)
    per_row, times = np.unique(row[real] * len(words) + code[real], return_counts=True)
    keys, place = np.unique(of[per_row // max(1, len(words))] * len(words) + per_row % max(1, len(words)), return_inverse=True)
    which = pa.array(keys // max(1, len(words)))
    return pa.table([
        names.column("lang").take(which), names.column("source").take(which), words.take(pa.array(keys % max(1, len(words)))),
        pa.array(np.bincount(place, times, len(keys)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
    ], schema=COUNTS)


def _merged(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.rename_columns(COUNTS.names).cast(COUNTS)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) as each task has counted them; a key may stand in many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            sizes = pc.binary_length(column_of(batch, "text")).to_numpy(zero_copy_only=False)
            for a, b in _pieces(sizes):
                held.append(_count_piece(batch.slice(a, b - a)))
                rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                if rows > HELD_ROWS // 2 and len(held) == 1:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(1 << 16)

    plain = docs.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    return plain.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose language and digest may be among ``keys``, by a bit filter of fixed size, so that other strings are not shuffled."""
    place = F.pmod(F.xxhash64("lang", "digest"), F.lit(1 << FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    words = keys.withColumn("_place", place).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6))
    # at most 2 ** (FILTER_BITS - 6) rows, however many keys
    return marked.join(F.broadcast(words), "_word").filter("getbit(_bits, cast(_place & 63 as int)) = 1").drop("_word", "_place", "_bits")


def kept_terms(pieces: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Of counted pieces with digests the kept terms (lang, t, term), numbered by t, and their counts (lang, source, t, n)."""
    counts = cut_lineage(pieces.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    wanted = cut_lineage(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest"))
    strings = _maybe(pieces.select("lang", "digest", "term"), wanted).groupBy("lang", "digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    names = cut_lineage(strings.join(wanted, ["lang", "digest"], "left_semi"))
    shared = names.filter("lo <> hi").select("lang", "digest")
    single = names.filter("lo = hi").select("lang", "digest", F.col("lo").alias("term"))
    if shared.isEmpty():
        kept = cut_lineage(single.withColumn("t", F.monotonically_increasing_id()))
        return kept, cut_lineage(counts.join(kept, ["lang", "digest"]).select("lang", "source", "t", "n"))
    apart = _maybe(pieces, shared).join(shared, ["lang", "digest"], "left_semi")
    apart = cut_lineage(apart.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    often = apart.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest", "term")
    both = single.withColumn("split", F.lit(False)).unionByName(often.withColumn("split", F.lit(True)))
    kept = cut_lineage(both.withColumn("t", F.monotonically_increasing_id()))
    whole = counts.join(kept.filter("not split"), ["lang", "digest"]).select("lang", "source", "t", "n")
    parted = apart.join(kept.filter("split"), ["lang", "digest", "term"]).select("lang", "source", "t", "n")
    return kept, cut_lineage(whole.unionByName(parted))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly; 0 without terms."""
    return F.expr(
        f"if({terms} = 0, 0L, 1L + (cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(20,0))) div cast({total} + 5 * {terms} as decimal(20,0)))"
    )


def _block_distances(width: int):
    def distances(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        """Partial distances of the sources a < b of two blocks over one block of terms; t = -1 marks a source's share of absent terms."""
        head = cells[cells["t"] < 0].sort_values("s")
        sources, base = head["s"].to_numpy(), head["p"].to_numpy()
        full = cells[cells["t"] >= 0]
        terms, column = np.unique(full["t"].to_numpy(), return_inverse=True)
        shares = np.repeat(base[:, None], len(terms), axis=1)
        shares[np.searchsorted(sources, full["s"].to_numpy()), column] = full["p"].to_numpy()
        first, second, apart = [], [], []
        for i in np.flatnonzero(sources // width == key[2]):
            later = np.flatnonzero((sources // width == key[3]) & (sources > sources[i]))
            first.append(np.full(len(later), sources[i]))
            second.append(sources[later])
            apart.append(np.abs(shares[later] - shares[i]).sum(axis=1))
        return pd.DataFrame({"lang": key[0], "a": np.concatenate(first), "b": np.concatenate(second), "d": np.concatenate(apart), "terms": len(terms)})

    return distances


def source_distances(scale: DataFrame, shares: DataFrame, block_terms: int = TERMS, block_sources: int = SOURCES) -> DataFrame:
    """(lang, source, item, value) for both directions of every pair of sources of a language.

    ``scale`` has (lang, source, s, v, p0): the source's number, the language's
    kept terms and the share of an absent term; ``shares`` has (lang, s, t, p).
    """
    blocks = F.expr(f"greatest(1L, (v + {block_terms - 1}) div {block_terms})")
    spread = scale.withColumn("blocks", blocks).withColumn("last", F.floor(F.max("s").over(Window.partitionBy("lang")) / block_sources))
    spread = cut_lineage(spread)
    heads = spread.select("lang", "s", "last", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("tb"), F.lit(-1).cast("bigint").alias("t"), F.col("p0").alias("p"))
    cells = shares.join(spread.select("lang", "s", "last", "blocks"), ["lang", "s"])
    cells = cells.select("lang", "s", "last", F.expr("pmod(xxhash64(t), blocks)").alias("tb"), "t", "p")
    own = F.floor(F.col("s") / block_sources)
    met = heads.unionByName(cells).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0L, last)")))
    met = met.select("lang", "tb", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "s", "t", "p")
    parts = met.groupBy("lang", "tb", "low", "high").applyInPandas(_block_distances(block_sources), "lang string, a bigint, b bigint, d bigint, terms bigint")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("d").alias("d"), F.sum("terms").alias("terms"))
    one = spread.select("lang", F.col("s").alias("a"), F.col("source").alias("source_a"), F.col("p0").alias("p0_a"), "v")
    two = spread.select("lang", F.col("s").alias("b"), F.col("source").alias("source_b"), F.col("p0").alias("p0_b"))
    value = F.col("d") + (F.col("v") - F.col("terms")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    valued = pairs.join(one, ["lang", "a"]).join(two, ["lang", "b"]).withColumn("value", value)
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    return valued.select("lang", F.explode(F.array(way("source_a", "source_b"), way("source_b", "source_a"))).alias("w"), "value").select("lang", "w.*", "value")


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64,
    block_terms: int = TERMS, block_sources: int = SOURCES,
) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for each other source, ``term`` rows for the ``top`` terms used more than in the language.

    ``digest_bits`` below 64 makes digests collide, which changes no result.
    """
    digest = F.xxhash64("term") if digest_bits >= 64 else F.pmod(F.xxhash64("term"), F.lit(1 << digest_bits))
    pieces = cut_lineage(term_counts(docs, text, lang, source).withColumn("digest", digest))
    kept, counts = kept_terms(pieces, min_docs)
    name = lambda c, n: F.coalesce(col(c).cast("string"), F.lit("")).alias(n)
    groups = docs.select(name(lang, "lang"), name(source, "source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    scale = groups.join(totals, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    scale = scale.fillna(0, ["total", "v"]).withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1)
    scale = cut_lineage(scale.withColumn("p0", _share("0", "total", "v")))
    shares = cut_lineage(counts.join(scale, ["lang", "source"]).select("lang", "source", "s", "t", "n", _share("n", "total", "v").alias("p")))
    pairs = source_distances(scale.select("lang", "source", "s", "v", "p0"), shares.select("lang", "s", "t", "p"), block_terms, block_sources)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    whole = scale.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    common = counts.groupBy("lang", "t").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "t", _share("n", "total", "v").alias("q"))
    more = shares.join(common, ["lang", "t"]).filter("p > q").select("lang", "source", "t", (F.col("p") - F.col("q")).alias("value"))
    first = more.withColumn("_r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("_r") <= top)
    named = first.join(kept.select("lang", "t", F.col("term").alias("item")), ["lang", "t"])
    terms = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
