"""Near-duplicate embeddings: an inverted multi-index, searched exactly and verified.

Unit vectors are cut into halves, each with a codebook of its own (k-means on a
sample of at most ``SAMPLE`` vectors). The pairs of codewords are the cells of
the index, which holds every vector. A vector visits cells up to a lower bound
of its squared distance to them (how far it lies beyond the border of each
codeword's region, halves added): up to the distance of the threshold, so no
vector that links can lie in a cell left out. What it meets is compared by the
leading directions of the sample and the length of what they leave, an upper
bound of the cosine; what passes is verified by cosine in double precision.

Rows are put in order of their cells by one shuffle, which brings copies of a
vector together as one entry with a count, and packed into blocks of at most
``BLOCK_ROWS`` entries. Blocks meet as a product of bounded groups of blocks, so
no vector is copied to the cells that it visits, and a block that no row of
another visits is left out before its rows are compared. Two blocks meet once.
A task returns counts per vector and spanning forests of the links, never all
pairs.

Defined cases: null, zero, non-finite or partly null vectors link with nothing;
vectors of another length than most are searched exactly among their like; rows
with the same id and vector are one vector; an empty table gives an empty
result; extra columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import NO_ID, col, column_of, id_of
from fieldlake.llm.graph import components
from fieldlake.session import cut_lineage

COSINE = 0.95
ROUNDING = 1e-9  # added to the bound; far above the rounding of squared distances
SAMPLE = 20_000
BLOCK_ROWS = 4096
TILE = 256  # rows whose products with a block are held at once
BLOCK_COPIES = 32  # ids that a block holds at most for each of its entries; a vector with more copies has several entries
GROUP_BYTES = 32 << 20  # of vectors that meet in a task, on either side
DIRECTIONS = 16
CELL_ROWS = 1024
MAX_WORDS = 1024
SEED = 7


def _entries(vectors: DataFrame, vector: str, id_name: str, grid=None) -> DataFrame:
    """(id, k1, k2, dim, raw) of usable vectors, and their cell where a grid is given; raw holds little-endian floats, or doubles if floats
    don't hold the values. Vectors of other lengths than the grid's have one cell for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, dims, raws = [], [], [], []
            for places, x in _rows_by_length(column_of(batch, "v")):
                top = np.abs(x).max(axis=1)
                with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                    short = x.astype("<f4")
                    floats = (short == x).all(axis=1)
                own = column_of(batch, "id").take(pa.array(places)).to_pylist()
                for j in np.flatnonzero(np.isfinite(top) & (top > 0)):
                    ids.append(own[j])
                    keys.append(xxhash.xxh3_128_digest(x[j].tobytes()))
                    dims.append(x.shape[1])
                    raws.append((short if floats[j] else x)[j].tobytes())
            two = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())]
            if grid is not None:
                g, cells = grid.value, -np.array(dims, np.int64)
                ours = np.flatnonzero(cells == -g.dim) if g.half else np.empty(0, int)
                for some in np.array_split(ours, len(ours) // 1000 + 1) if len(ours) else []:
                    cells[some] = g.cells(_units([raws[j] for j in some], g.dim))
                columns.append(pa.array(cells, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k1", "k2", "dim", "raw", "cell"][: len(columns)])

    source = vectors.select(id_of(id_name).alias("id"), col(vector).alias("v"))
    return source.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, dim int, raw binary" + (", cell bigint" if grid is not None else ""))


def _rows_by_length(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the lists without nulls, by their length."""
    lengths = pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == n)
        flat = v.take(pa.array(places)).flatten()
        gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, n)
        yield (places[~gaps], x[~gaps]) if gaps.any() else (places, x)


def _values(raws: list[bytes], dim: int) -> np.ndarray:
    """A matrix of the values: of floats if all rows are."""
    if all(len(r) == 4 * dim for r in raws):
        return np.frombuffer(b"".join(raws), "<f4").reshape(-1, dim)
    return np.array([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in raws], np.float64).reshape(-1, dim)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y = y / np.abs(y).max(axis=1, keepdims=True)
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def _units(raws: list[bytes], dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    return _unit_rows(_values(raws, dim)) if raws else np.zeros((0, dim))


# ---- the index ------------------------------------------------------------

def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(-2 * x @ centres.T + (centres**2).sum(1), 1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Grid:
    """Codebooks of the halves, and the bound up to which cells are visited."""

    def __init__(self, sample: np.ndarray, words: int, cosine: float):
        self.dim, half = sample.shape[1], sample.shape[1] // 2
        self.half, self.words = half, words
        self.books = [k_means(sample[:, :half], words), k_means(sample[:, half:], words)] if half else []
        self.gaps = [np.array([np.linalg.norm(book - c, axis=1) for c in book]) for book in self.books]
        self.stop = 2 - 2 * cosine + ROUNDING
        self.main = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :DIRECTIONS]  # the directions along which the sample is longest

    def _squares(self, x: np.ndarray) -> list[np.ndarray]:
        parts = [x[:, : self.half], x[:, self.half :]]
        return [np.maximum((p**2).sum(1)[:, None] - 2 * p @ b.T + (b**2).sum(1), 0) for p, b in zip(parts, self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (s.argmin(1) for s in self._squares(x))
        return one * self.words + two

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances to the regions of all codewords, those of both halves side by side."""
        out = []
        for s, gap in zip(self._squares(x), self.gaps):
            near = s.argmin(1)
            # less the rounding of the squares, which counts where codewords are equal or nearly so
            beyond = (s - s[np.arange(len(s)), near][:, None] - 1e-12) / np.maximum(2 * gap[near], 1e-300)
            out.append(np.maximum(beyond, 0) ** 2)
        return np.hstack(out)

    def visits(self, bounds: np.ndarray) -> np.ndarray:
        """The cells to visit, nearest first."""
        one, two = np.argsort(bounds[: self.words]), np.argsort(bounds[self.words :])
        a, b = bounds[one], bounds[self.words + two]
        one, a = one[a <= self.stop], a[a <= self.stop]
        ends = np.searchsorted(b, self.stop - a, side="right")  # along each row of the grid the sums only grow
        i = np.repeat(np.arange(len(a)), ends)
        j = np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
        return (one[i] * self.words + two[j])[np.argsort(a[i] + b[j], kind="stable")]

    def visited(self, bounds: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of the cells the vectors of these bounds visit (vectors x cells), as :meth:`visits` lists them."""
        return bounds[:, cells // self.words] <= self.stop - bounds[:, self.words + cells % self.words]

    def shortened(self, x: np.ndarray) -> np.ndarray:
        """Single-precision rows whose products are, but for rounding, no smaller than those of ``x``."""
        part = x @ self.main
        return np.column_stack([part, np.sqrt(np.maximum(1 - (part**2).sum(1), 0))]).astype(np.float32)


_BLOCK = "block bigint, dim int, cells array<bigint>, near array<double>, ids array<bigint>, counts array<bigint>, at array<int>, raw binary, members array<bigint>, owners array<int>"


def _blocks(placed: DataFrame, grid, block_rows: int) -> DataFrame:
    """Blocks of rows in order of cell, vector and id. ``cells`` are a block's cells and ``at`` the place among them of each entry, ``near``
    the least bounds of its entries, ``members`` all ids and ``owners`` the entries that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, here, made = grid.value, TaskContext.get().partitionId() << 32, 0
        ids, counts, cells, raws, members, owners = [], [], [], [], [], []
        last = before = None

        def block(dim: int) -> pa.RecordBatch:
            own, at = np.unique(np.array(cells, np.int64), return_inverse=True)
            x = _values(raws, dim)
            ours = g.half and dim == g.dim
            near = np.min([g.bounds(_unit_rows(x[a : a + 1000])).min(0) for a in range(0, len(x), 1000)], axis=0) if ours else []
            row = {"block": here + made, "dim": dim, "cells": own, "near": near, "ids": ids, "counts": counts, "at": at.ravel().astype(np.int32), "raw": x.tobytes(), "members": members, "owners": owners}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("cells", pa.list_(pa.int64())), ("near", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())),
                            ("counts", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("raw", pa.binary()), ("members", pa.list_(pa.int64())), ("owners", pa.list_(pa.int32()))])
        for batch in batches:
            names = ("cell", "k1", "k2", "id", "dim")
            found = zip(*(column_of(batch, n).to_pylist() for n in names))
            raw = column_of(batch, "raw")
            for i, (cell, k1, k2, id_, dim) in enumerate(found):
                key = (cell, k1, k2, dim)
                if (key, id_) == before:  # the same row again
                    continue
                before = (key, id_)
                full = len(ids) == block_rows and key != last or len(members) >= BLOCK_COPIES * block_rows
                if ids and (full or dim != last[3]):
                    yield block(last[3])
                    made, last = made + 1, None
                    ids, counts, cells, raws, members, owners = [], [], [], [], [], []
                if key == last:
                    counts[-1] += 1
                else:
                    ids.append(id_)
                    counts.append(1)
                    cells.append(cell)
                    raws.append(raw[i].as_py())
                members.append(id_)
                owners.append(len(ids) - 1)
                last = key
        if ids:
            yield block(last[3])

    order = ["cell", "k1", "k2", "id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.mapInArrow(run, _BLOCK))


# ---- search ---------------------------------------------------------------

def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (row numbers) of the rows and columns of a matrix of links; every row and column has one."""
    rows, none = np.arange(len(linked)), len(linked)
    while True:
        columns = np.where(linked, rows[:, None], none).min(0)
        new = np.minimum(rows, np.where(linked, columns[None, :], none).min(1))
        if (new == rows).all():
            return rows, columns
        rows = new


def _links(cosine: float, x: np.ndarray, y: np.ndarray, short_x: np.ndarray | None, short_y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of y with a pair of that cosine, and which of them make one."""
    if short_x is None:
        links = _unit_rows(x) @ _unit_rows(y).T >= cosine
    else:
        least, space, one, maybe = np.float32(cosine - 1e-5), np.empty((TILE, len(short_y)), np.float32), [], []
        for a in range(0, len(short_x), TILE):
            part = short_x[a : a + TILE]
            bounds = np.matmul(part, short_y.T, out=space[: len(part)])
            hit = np.flatnonzero(bounds.max(axis=1, initial=-1) >= least)
            one.append(a + hit)
            maybe.append(bounds[hit] >= least)
        one, two = np.concatenate([*one, np.empty(0, int)]).astype(int), np.empty(0, int)
        if not len(one):
            return one, two, np.zeros((0, 0), bool)
        maybe = np.concatenate(maybe)
        two = np.flatnonzero(maybe.any(0))
        maybe = maybe[:, two]
        u, v = _unit_rows(x[one]), _unit_rows(y[two])
        if maybe.sum() < 20 * (len(one) + len(two)):
            i, j = np.nonzero(maybe)
            links = np.zeros(maybe.shape, bool)
            links[i, j] = np.einsum("ij,ij->i", u[i], v[j]) >= cosine
        else:
            links = u @ v.T >= cosine
        return one, two, links
    return np.arange(len(x)), np.arange(len(y)), links


def _search(grid, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grid.value
        total: dict[int, list] = {}  # per block its ids and their links so far
        held: dict[int, np.ndarray | None] = {}  # shortened entries of the blocks met
        left, bounds = None, None

        def shortened(block: int, x: np.ndarray) -> np.ndarray | None:
            if block not in held:
                own = g.half and x.shape[1] == g.dim
                held[block] = np.concatenate([g.shortened(_unit_rows(x[a : a + 1000])) for a in range(0, len(x), 1000)]) if own else None
            return held[block]

        def add(block: int, ids: np.ndarray, rows: np.ndarray, n: np.ndarray) -> None:
            if block not in total:
                total[block] = [ids.copy(), np.zeros(len(ids), np.int64)]
            total[block][1][rows] += n

        for batch in batches:
            columns = {n: column_of(batch, n) for n in batch.schema.names}
            for p in range(batch.num_rows):
                dim, a, b = columns["dim"][p].as_py(), columns["block"][p].as_py(), columns["y_block"][p].as_py()
                array = lambda name: columns[name][p].values.to_numpy()  # noqa: B023, E731
                xs, ys = array("ids"), array("y_ids")
                x, y = (_from_buffer(columns[c][p].as_buffer(), n, dim) for c, n in (("raw", len(xs)), ("y_raw", len(ys))))
                sx, sy = shortened(a, x), shortened(b, y)
                rows, columns_ = np.arange(len(xs)), np.arange(len(ys))
                if sx is not None:
                    if a != left:
                        left, bounds = a, np.concatenate([g.bounds(_unit_rows(x[i : i + 1000])) for i in range(0, len(x), 1000)])
                    seen = g.visited(bounds, array("y_cells"))
                    rows, columns_ = np.flatnonzero(seen.any(1)), np.flatnonzero(seen.any(0)[array("y_at")])
                    whole = len(rows) == len(xs), len(columns_) == len(ys)
                    sx, sy = sx if whole[0] else sx[rows], sy if whole[1] else sy[columns_]
                    x, y = x if whole[0] else x[rows], y if whole[1] else y[columns_]
                one, two, links = _links(cosine, x, y, sx, sy)
                one, two = rows[one], columns_[two]
                links &= xs[one][:, None] != ys[two][None, :]
                i, j = links.any(1), links.any(0)
                if not i.any():
                    continue
                one, two, links = one[i], two[j], links[np.ix_(i, j)]
                add(a, xs, one, links @ array("y_counts")[two])
                if a != b:
                    add(b, ys, two, links.T @ array("counts")[one])
                own, other = forest(links)
                yield _found(np.concatenate([xs[one], ys[two]]), np.concatenate([xs[one][own], xs[one][other]]), np.zeros(len(one) + len(two), np.int64))
        for ids, n in total.values():
            yield _found(ids[n > 0], np.zeros((n > 0).sum(), np.int64), n[n > 0])

    return run


def _found(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Links of entries, or edges of a forest where n is 0."""
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _from_buffer(raw: pa.Buffer, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if raw.size == 4 * n * dim else "<f8").reshape(n, dim)


def _meetings(blocks: DataFrame, grid, parallel: int) -> DataFrame:
    """Pairs of blocks, each in one order only, of which some row of the one may visit a cell of the other.

    Groups of blocks meet by a product that reads one copy of them, in tasks that hold two groups. Of two blocks whose numbers
    add up to an even one the lower comes first, else the higher, so that all groups have as much to do.
    """
    n, held = blocks.agg(F.count("*"), F.sum(F.length("raw"))).first()
    groups = max(math.ceil((held or 0) / GROUP_BYTES), min(n, 2 * math.ceil(math.sqrt(2 * parallel))), 1)
    dealt = blocks.select("block", "dim", "cells", "near", "ids", "counts", "at", "raw").repartition(groups)
    left, right = dealt, dealt.toDF(*(f"y_{c}" for c in dealt.columns))
    a, b, g = F.col("block"), F.col("y_block"), grid.value
    one_way = (a == b) | F.when((a + b) % 2 == 0, a < b).otherwise(a > b)
    words = F.lit(g.words).cast("bigint")
    bound = lambda c: F.get("near", F.floor(c / words).cast("int")) <= F.lit(g.stop) - F.get("near", (words + c % words).cast("int"))
    meets = F.when(F.size("near") > 0, F.exists("y_cells", bound)).otherwise(F.lit(True))
    alike = F.abs(F.col("dim") - F.col("y_dim")) < 1  # an equality would deal the blocks by their length
    return left.join(right.hint("shuffle_replicate_nl"), one_way & alike & meets).drop("y_dim", "y_near", "cells", "near", "at")


def linked_vectors(
    vectors: DataFrame, vector: str = "embedding", id_name: str = "vec_id", cosine: float = COSINE,
    sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per distinct id."""
    spark = vectors.sparkSession
    found = _entries(vectors, vector, id_name)
    keys = cut_lineage(found.groupBy("k1", "k2").agg(F.first("dim").alias("dim")))
    total = keys.count()
    usual = keys.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 0
    wanted = keys.filter(F.col("dim") == dim).orderBy(F.xxhash64("k1", "k2")).limit(sample).select("k1", "k2")
    fitted = found.join(F.broadcast(wanted), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("raw").alias("raw"))  # at most ``sample`` keys
    points = _units(fitted.orderBy(F.xxhash64("k1", "k2")).select("raw").toArrow().column("raw").to_pylist(), dim)
    words = min(int(np.clip(np.sqrt(total / CELL_ROWS), 2, MAX_WORDS)), len(points))
    if dim < 2 or words < 1:
        points, words = np.zeros((1, 0)), 1
    grid = spark.sparkContext.broadcast(Grid(points, words, cosine) if points.shape[1] else _NoGrid())
    blocks = _blocks(_entries(vectors, vector, id_name, grid), grid, block_rows)
    met = _meetings(blocks, grid, spark.sparkContext.defaultParallelism).mapInArrow(_search(grid, cosine), "a bigint, b bigint, n bigint")
    met = cut_lineage(met)
    counts = met.groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(met.filter("n = 0").select("a", "b"))
    member = F.explode(F.arrays_zip("members", "owners")).alias("_m")
    per_id = blocks.select("ids", "counts", member).select(
        F.col("_m.members").alias("id"), F.get("ids", F.col("_m.owners")).alias("entry"), F.get("counts", F.col("_m.owners")).alias("n"))
    named = per_id.join(counts, F.col("entry") == F.col("a"), "left").join(groups, F.col("entry") == F.col("node"), "left")
    named = named.groupBy("id").agg(
        F.sum(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.min(F.coalesce("component", "entry")).alias("component"))
    everyone = vectors.select(id_of(id_name).alias("id")).distinct().join(named, "id", "left")
    null = lambda c: F.when(c != F.lit(NO_ID), c)
    component = F.coalesce("component", "id")
    return everyone.select(
        null(F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        null(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )


class _NoGrid:
    """Stands for the grid where vectors have no halves; every vector is then searched exactly."""

    dim, half, words, stop = 0, 0, 1, 0.0
