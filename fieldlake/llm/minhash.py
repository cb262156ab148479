"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a weighted set of shingles of five words, weight = count * (1 +
``IDF_SHARE`` * log(N / df) / log N). The factor's range is kept narrow, or the
shingles that a large group of copies shares would count for nearly nothing and
its members would no longer look alike. Document frequencies come from all
documents, through a table of ``COUNTERS`` counters addressed by hash; the mean
load of a counter is taken off, so shingles rarer than its noise count as rare.

Documents with the same words in the same order are one class, of which one goes
on. ``BANDS`` bands of ``ROWS`` samples make buckets. A bucket's members meet
three of its members (the smallest id, the largest, one by hash); the pairs are
verified by weighted Jaccard similarity of the whole texts. Where a bucket still
holds several components, its members are compared block by block: pairs of
different components of whose samples at least ``NEAR`` agree are verified inside
the task, and only links that join components leave it. So large groups cost a
few pairs per document, tasks hold two blocks of ``BLOCK_ROWS`` members, and no
bucket is gathered or capped.

Defined cases: null, empty and wordless texts link with nothing; rows that share
an id are one document that has all their links; a null id is a document of its
own, before all others; an empty table gives an empty result; of extra columns
only those named like an added one are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import NO_ID, col, column_of, id_of, mixed, segments, shingle_groups, texts_of
from fieldlake.llm.graph import components
from fieldlake.session import cut_lineage

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
IDF_SHARE = 0.25
COUNTERS_LOG2 = 20
BLOCK = 1 << 12
BLOCK_ROWS = 512
PIECE_ROWS = 512  # rows whose texts a worker holds as sets at a time
NEAR = 0.64  # more than three standard deviations below the similarity sought
TABLE_LOG2 = 16
ID_BITS_LOG2 = 27  # 16 MB
SEED = 20240


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``PIECE_ROWS`` rows: what is made of the texts is held for one part at a time."""
    for start in range(0, batch.num_rows, PIECE_ROWS):
        yield batch.slice(start, PIECE_ROWS)


# ---- document frequencies -------------------------------------------------

def _counters(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max()))
    return zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(data: bytes, block: int) -> np.ndarray:
    raw = zlib.decompress(data)
    kind = f"<u{len(raw) // BLOCK}" if block >= 0 else "<i8"
    return np.frombuffer(raw, kind).astype(np.int64)


def frequency_weights(docs: DataFrame, text: str = "text"):
    """Broadcast weights (float32, one per counter) from the document frequencies of all shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << COUNTERS_LOG2, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, shingles in (g for piece in _pieces(batch) for g in shingle_groups(texts_of(piece, "t"), WIDTH)):
                owner = mixed(np.repeat(np.arange(len(shingles), dtype=np.uint64), [len(s) for s in shingles]) + np.uint64(1))
                flat = np.concatenate(shingles)
                _, first = np.unique(flat ^ owner, return_index=True)
                total += np.bincount(_counters(flat[first]), minlength=len(total))
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([zlib.compress(np.int64(rows).tobytes()), *(_packed(blocks[i]) for i in used)], pa.binary())],
            names=["block", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpacked(counts, block)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "counts"]
        )

    spark = docs.sparkSession
    kind = "block int, counts binary"
    found = docs.select(col(text).cast("string").alias("t")).mapInArrow(count, kind).repartition("block").mapInArrow(add, kind)
    total, n = np.zeros(1 << COUNTERS_LOG2), 0
    for row in found.collect():  # at most one row per block: the size of the table of counters
        if row.block < 0:
            n += int(_unpacked(row.counts, row.block)[0])
        else:
            total[row.block * BLOCK : (row.block + 1) * BLOCK] = _unpacked(row.counts, row.block)
    return spark.sparkContext.broadcast(idf_weights(total, n))


def idf_weights(total: np.ndarray, n: int) -> np.ndarray:
    mean = (total.sum() - total) / (len(total) - 1)
    df = np.clip(total - mean, 1, max(n, 1))
    return (1 + IDF_SHARE * np.log(max(n, 1) / df) / np.log(max(n, 2))).astype(np.float32)


def weighted_set(shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their weights."""
    h, counts = np.unique(shingles, return_counts=True)
    return h, counts * weights[_counters(h)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


# ---- samples --------------------------------------------------------------

class Sampler:
    """Consistent weighted samples. A shingle's random numbers are picked by its hash from tables of 2**TABLE_LOG2 draws."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = (samples, 1 << TABLE_LOG2)
        self.r, self.c = np.empty(size, np.float32), np.empty(size, np.float32)
        for row in self.r:  # row by row: no table is held in double precision
            row[:] = rng.gamma(2.0, 1.0, size[1])
        for row in self.c:
            row[:] = np.log(rng.gamma(2.0, 1.0, size[1]))
        self.beta = rng.random(size, dtype=np.float32)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, h: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row per set: hashes of the chosen (shingle, level) pairs. No set is empty."""
        starts = segments(sizes)[:-1]
        log_w = np.log(w).astype(np.float32)
        out = np.empty((len(sizes), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            at = ((h * odd) >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)
            r, beta = self.r[k][at], self.beta[k][at]
            level = np.floor(log_w / r + beta)
            log_a = self.c[k][at] - r * (level - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, starts)
            hits = np.flatnonzero(log_a == np.repeat(least, sizes))
            first = hits[np.searchsorted(hits, starts)]  # of equal ones the smallest hash: sets are in order of hash
            out[:, k] = mixed(h[first] ^ mixed(level[first].astype(np.int64).view(np.uint64) + np.uint64(k)))
        return out


_SAMPLERS: dict[tuple[int, int], Sampler] = {}


def _sampler() -> Sampler:
    key = (BANDS * ROWS, SEED)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(*key)
    return _SAMPLERS[key]


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signatures), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys ^ signatures[:, r::ROWS]) + np.uint64(r)
    return keys


def _sketches(docs: DataFrame, weights, text: str, id_name: str) -> DataFrame:
    """(id, k1, k2, bands, samples) of the documents with words; k1, k2 are a hash of the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            ids = column_of(batch, "id").to_numpy(zero_copy_only=False)
            for begin, words, shingles in shingle_groups(texts_of(batch, "t"), WIDTH):
                some = [i for i, s in enumerate(shingles) if len(s)]
                if not some:
                    continue
                sets = [weighted_set(shingles[i], weights.value) for i in some]
                sizes = np.array([len(h) for h, _ in sets])
                samples = sampler.signatures(np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets]), sizes)
                keys, short = band_keys(samples), np.ascontiguousarray(samples.astype("<u4"))
                same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(words[i].tobytes()) for i in some), "<i8").reshape(-1, 2)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[[begin + i for i in some]], pa.int64()), pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy()), bands,
                     pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["id", "k1", "k2", "bands", "samples"],
                )

    source = docs.select(id_of(id_name).alias("id"), col(text).cast("string").alias("t"))
    return source.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, bands array<bigint>, samples binary")


# ---- pairs ----------------------------------------------------------------

def _verified(pairs: DataFrame, docs: DataFrame, weights, text: str, id_name: str, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar, with their similarity."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = _among(docs.select(id_of(id_name).alias("id"), col(text).cast("string").alias("t")), ids)
    texts = cut_lineage(some.join(ids, "id").distinct())
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            coded = [column_of(batch, name).dictionary_encode() for name in ("ta", "tb")]  # a text of many pairs is read once
            sets = [
                [weighted_set(s, weights.value) for _, _, found in shingle_groups([t or "" for t in c.dictionary.to_pylist()], WIDTH) for s in found]
                for c in coded
            ]
            at, to = (c.indices.to_numpy(zero_copy_only=False) for c in coded)
            score = np.array([similarity(sets[0][i], sets[1][j]) for i, j in zip(at, to)])
            good = score >= least
            yield pa.RecordBatch.from_arrays([
                column_of(batch, "a").filter(pa.array(good)), column_of(batch, "b").filter(pa.array(good)), pa.array(score[good], pa.float64()),
            ], names=["a", "b", "similarity"])

    return cut_lineage(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double"))


def _bits(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) >> np.uint64(64 - ID_BITS_LOG2)).astype(np.int64)


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ``ids``, by a bitmap of fixed size, so that texts of no use are not shuffled."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(column_of(batch, "id").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["w", "b"])

    found = ids.mapInArrow(slots, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << (ID_BITS_LOG2 - 6), np.uint64)
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(id_: pd.Series) -> pd.Series:  # only ids go through Python, texts stay where they are
        bits = _bits(id_.to_numpy())
        return pd.Series((shared.value[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.filter(marked("id"))


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs of which at least ``NEAR`` of the samples agree."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    samples = cut_lineage(reps.join(ids, "rep").groupBy("rep").agg(F.collect_set("samples").alias("s")))
    both = pairs.join(samples.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(
        samples.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda v: np.frombuffer(b"".join(v), "<u4").reshape(-1, BANDS * ROWS)
        for batch in batches:
            good = [
                (read(x)[:, None, :] == read(y)[None, :, :]).mean(2).max() >= NEAR
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut_lineage(both.mapInArrow(keep, "a bigint, b bigint"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def duplicate_classes(
    docs: DataFrame, text: str = "text", id_name: str = "doc_id", least: float = SIMILARITY
) -> DataFrame:
    """(doc_id, class_id, copy_of): for each id the smallest id of its component, and the smallest with the same words."""
    weights = frequency_weights(docs, text)
    sketches = cut_lineage(_sketches(docs, weights, text, id_name))
    reps = cut_lineage(sketches.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("samples").alias("samples")))
    member = cut_lineage(sketches.select("id", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep").distinct())
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    rows = cut_lineage(reps.select("rep", F.posexplode("bands").alias("band", "key")).distinct())
    centres = rows.groupBy("band", "key").agg(
        F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min(F.struct(F.xxhash64("rep").alias("x"), "rep")).alias("mid")
    ).filter("lo < hi").select("band", "key", F.array_distinct(F.array("lo", "hi", "mid.rep")).alias("centres"))
    centres = cut_lineage(centres)
    shared = cut_lineage(rows.join(centres, ["band", "key"]))  # members of buckets with more than one
    pairs = shared.select("rep", F.explode("centres").alias("c")).filter("rep <> c").select(*_ordered("rep", "c")).distinct()
    pairs = cut_lineage(pairs)
    links = _verified(_alike(pairs, reps), docs, weights, text, id_name, least)
    links = cut_lineage(links.select("a", "b").unionByName(several))
    groups = components(links)
    more = _remaining_links(shared, reps, groups, docs, weights, text, id_name, least)
    if not more.isEmpty():
        # what is linked already is as well said by its component
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(known.unionByName(more))
    named = member.groupBy("id").agg(F.min("rep").alias("rep"))
    named = named.join(groups, F.col("rep") == F.col("node"), "left").select(
        "id", F.coalesce("component", "rep").alias("class"), F.col("rep").alias("copy"))
    everyone = docs.select(id_of(id_name).alias("id")).distinct().join(named, "id", "left")
    null = lambda c: F.when(c != F.lit(NO_ID), c)
    return everyone.select(
        null(F.col("id")).alias("doc_id"), null(F.coalesce("class", "id")).alias("class_id"), null(F.coalesce("copy", "id")).alias("copy_of"),
    )


def _cross_links(weights, least: float):
    """Links between members of two blocks of a bucket that are in different components, at most one for each merge.

    Pairs whose samples agree in at least ``NEAR`` of the places are verified by their whole texts, the likeliest first;
    pairs of components that a link has joined by then are left out. A pair that meets in several buckets is taken in the
    first only.
    """

    def run(key, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        band, found = key[0].as_py(), []
        if ours.num_rows and theirs.num_rows:
            sides = (ours, theirs)
            samples = [np.frombuffer(b"".join(t.column("samples").to_pylist()), "<u4").reshape(-1, BANDS * ROWS) for t in sides]
            bands = [np.array(t.column("bands").combine_chunks().values).reshape(-1, BANDS) for t in sides]
            comps, reps = ([t.column(c).to_numpy() for t in sides] for c in ("comp", "rep"))
            agree = np.zeros((ours.num_rows, theirs.num_rows), np.uint8)
            for k in range(BANDS * ROWS):
                agree += samples[0][:, k, None] == samples[1][None, :, k]
            open_ = (agree >= NEAR * BANDS * ROWS) & (comps[0][:, None] != comps[1][None, :]) & (reps[0][:, None] < reps[1][None, :])
            for k in range(band):
                open_ &= bands[0][:, k, None] != bands[1][None, :, k]
            i, j = np.nonzero(open_)
            order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
            texts = [t.column("t").to_pylist() for t in sides]
            sets: list[dict[int, tuple]] = [{}, {}]
            head: dict[int, int] = {}

            def root(c: int) -> int:
                while head.get(c, c) != c:
                    c = head[c]
                return c

            def weighted(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
                if n not in sets[side]:
                    (_, _, shingles), = shingle_groups([texts[side][n] or ""], WIDTH)
                    sets[side][n] = weighted_set(shingles[0], weights.value)
                return sets[side][n]

            for x, y in zip(i[order].tolist(), j[order].tolist()):
                p, q = root(int(comps[0][x])), root(int(comps[1][y]))
                if p != q and similarity(weighted(0, x), weighted(1, y)) >= least:
                    head[max(p, q)] = min(p, q)
                    found.append((int(reps[0][x]), int(reps[1][y])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _remaining_links(shared: DataFrame, reps: DataFrame, groups: DataFrame, docs: DataFrame, weights, text: str, id_name: str, least: float) -> DataFrame:
    """Links between components that share a bucket, found block by block."""
    placed = cut_lineage(shared.select("band", "key", "rep").join(groups, F.col("rep") == F.col("node"), "left").select(
        "band", "key", "rep", F.coalesce("component", "rep").alias("comp")))
    mixed_up = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y")
    mixed_up = cut_lineage(mixed_up.select("band", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    placed = cut_lineage(placed.join(mixed_up, ["band", "key"]))
    ids = cut_lineage(placed.select(F.col("rep").alias("id")).distinct())
    texts = _among(docs.select(id_of(id_name).alias("id"), col(text).cast("string").alias("t")), ids).join(ids, "id")
    known = cut_lineage(texts.join(reps.select(F.col("rep").alias("id"), "samples", "bands"), "id").select(F.col("id").alias("rep"), "samples", "bands", "t"))
    placed = placed.join(known, "rep")
    own, every = F.pmod(F.xxhash64("rep"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = ["rep", "comp", "samples", "bands", "t"]
    ours = placed.select("band", "key", own.alias("a"), every.alias("b"), *cells)
    theirs = placed.select(
        F.col("band").alias("band_"), F.col("key").alias("key_"), every.alias("a_"), own.alias("b_"), *(F.col(c).alias(c) for c in cells))
    met = ours.groupBy("band", "key", "a", "b").cogroup(theirs.groupBy("band_", "key_", "a_", "b_"))
    return cut_lineage(met.applyInArrow(_cross_links(weights, least), "a bigint, b bigint"))


def drop_duplicates(docs: DataFrame, text: str = "text", id_name: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document (the smallest id) of each class."""
    classes = duplicate_classes(docs, text, id_name, least)
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(id_of("doc_id").alias("_gone"))
    return docs.join(cut_lineage(gone), id_of(id_name) == F.col("_gone"), "left_anti")
