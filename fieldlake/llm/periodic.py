"""Periodic runs of words: stretches that repeat a short word sequence at least ``POWER`` times.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are the same) of at least ``max(LEAST, POWER * q)`` words. Every word of a
run occurs at least ``POWER`` times in it, which gives the method: a word that
occurs less often within its segment belongs to no run, so it splits the
segment. The parts are counted anew and split again until no part changes. What
survives is scanned lag by lag.

The splitting works on all texts of a piece at once, a sort per level, as long as
a level takes a fair share of the words. Segments that shrink slowly go on with
counts that the largest part inherits from its segment, so every word is counted
a logarithmic number of times at most. The scan of a lag q compares hashes of
the blocks between multiples of q, of which a run holds three alike in a row;
words are compared only around such places, and places inside a run found before
whose period divides q are passed over. A segment of n words costs about
n log n, whatever it holds. Each text is worked on by itself; no rows are
shuffled.

Words are separated by blanks, tabs and line ends (x20, x09 to x0D) alone.

Defined cases: a null text has no words, no runs and an empty collapsed text;
repeated rows and null ids are treated row by row; an empty table gives an empty
table; columns named like an added one are replaced, all others stay.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import SPACE, col, column_of, grouped, map_arrow, mixed, segments

LEAST, POWER = 6, 4
FAIR_SHARE = 16  # a level that removes less than this part of the words hands over to the slow splitting
BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _bounds(at: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of consecutive places of one owner."""
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
    return list(zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + 1).tolist()))


def _split_slowly(codes: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """The stable parts of one segment; of a split segment the largest part keeps the counts, less those of the others."""
    places = defaultdict(list)
    for i in range(start, end):
        places[codes[i]].append(i)
    counts = Counter(codes[start:end])
    todo, out = [(start, end, counts, [c for c, n in counts.items() if n < POWER])], []
    while todo:
        a, b, counts, rare = todo.pop()
        if b - a < LEAST:
            continue
        if not rare:
            out.append((a, b))
            continue
        cuts = sorted({i for c in rare for i in places[c][bisect.bisect_left(places[c], a) : bisect.bisect_left(places[c], b)]})
        parts = list(zip([a, *(i + 1 for i in cuts)], [*cuts, b]))
        largest = max(parts, key=lambda p: p[1] - p[0])
        gone = Counter(codes[i] for i in cuts)
        for p in parts:
            if p != largest:
                own = Counter(codes[p[0] : p[1]])
                gone.update(own)
                todo.append((*p, own, [c for c, n in own.items() if n < POWER]))
        for c, n in gone.items():
            counts[c] -= n
        todo.append((*largest, counts, [c for c in gone if 0 < counts[c] < POWER]))
    return out


def stable_segments(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in which every word occurs at least ``POWER`` times and that hold every run; ``owner`` is the text of each word."""
    at, seg, out = np.arange(len(codes)), owner.astype(np.int64), []
    kinds = int(codes.max()) + 1 if len(codes) else 1
    while len(at):
        _, which, times = np.unique(seg * kinds + codes[at], return_inverse=True, return_counts=True)
        often = times[which] >= POWER
        changed = np.zeros(int(seg.max()) + 1, bool)
        changed[seg[~often]] = True
        done = ~changed[seg]
        out += [b for b in _bounds(at[done], seg[done]) if b[1] - b[0] >= LEAST]
        left = often & ~done
        if not left.any():
            break
        slow = (~often).sum() * FAIR_SHARE < (~done).sum()
        parts = [b for b in _bounds(at[left], seg[left]) if b[1] - b[0] >= LEAST]
        if slow:
            listed = codes.tolist()
            out += [b for a, e in parts for b in _split_slowly(listed, a, e)]
            break
        sizes = np.array([b - a for a, b in parts], np.int64)
        seg = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(segments(sizes)[:-1], sizes) + np.repeat(np.array([a for a, _ in parts], np.int64), sizes)
    return out


def _inside(found: dict[int, tuple[list, list]], q: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which ranges lie in a run found before whose period divides q; runs of one period are in order of start and of end."""
    covered = np.zeros(len(first), bool)
    for p, (starts, ends) in found.items():
        if q % p == 0:
            i = np.searchsorted(np.array(starts), first, "right") - 1
            covered |= (i >= 0) & (np.array(ends)[np.maximum(i, 0)] >= last)
    return covered


def scan_lags(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment."""
    n, out, found = len(codes), [], {}
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    for q in range(1, n // POWER + 1):
        blocks = np.diff(sums[: n + 1 : q])
        same = blocks[:-1] * power[q] == blocks[1:]
        triple = np.flatnonzero(same[:-1] & same[1:])
        if not len(triple):
            continue
        cut = np.flatnonzero(np.diff(triple) != 1)
        first = triple[np.concatenate([[0], cut + 1])] * q
        last = (triple[np.concatenate([cut, [len(triple) - 1]])] + 3) * q
        least = max(LEAST, POWER * q)
        open_ = (last - first + 2 * (q - 1) >= least) & ~_inside(found, q, first, last)
        for a, b in zip(first[open_].tolist(), last[open_].tolist()):
            # a run reaches less than q beyond the blocks on either side
            a, b = max(0, a - q), min(n, b + q)
            unlike = np.flatnonzero(codes[a : b - q] != codes[a + q : b])
            edges = np.concatenate([[-1], unlike, [b - q - a]])
            for i in np.flatnonzero(np.diff(edges) - 1 + q >= least):
                run = (a + int(edges[i]) + 1, int(edges[i + 1] - edges[i]) - 1 + q, q)
                starts, ends = found.setdefault(q, ([], []))
                if not starts or run[0] > starts[-1]:
                    starts.append(run[0])
                    ends.append(run[0] + run[1])
                    out.append(run)
    return out


def runs_of_texts(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Per text its words and its runs (start, length, period) in order of start and period."""
    words = [t.split() for t in texts]  # bytes are split at x20 and x09 to x0D alone
    sizes = np.array([len(w) for w in words], np.int64)
    offsets = segments(sizes)
    coded = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = [[] for _ in texts]
    for a, b in stable_segments(codes, np.repeat(np.arange(len(texts)), sizes)):
        text = int(np.searchsorted(offsets, a, "right")) - 1
        runs[text] += [(int(a - offsets[text]) + s, n, q) for s, n, q in scan_lags(codes[a:b])]
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(words, runs)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start and period) and collapsed, the text with each run cut to one period."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        runs, collapsed, sizes = [], [], []
        texts = [x or "" for x in column_of(batch, text).to_pylist()]
        for _, some in grouped(texts):
            for words, found in runs_of_texts([t.encode() for t in some]):
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                collapsed.append(_collapsed(words, found).decode())
        return {"n_words": pa.array(sizes, pa.int64()), "runs": pa.array(runs, RUN_TYPE), "collapsed": pa.array(collapsed, pa.string())}

    return map_arrow(docs, work, [("n_words", "bigint"), ("runs", RUN), ("collapsed", "string")])


def with_planted_runs(docs: DataFrame, text: str = "text", id_name: str = "doc_id") -> DataFrame:
    """``docs`` where one id in ten repeats a part of its text, by the checksum of the id; a null id never does."""
    h = F.crc32(col(id_name).cast("string").cast("binary"))
    words = F.filter(F.split(col(text), f"[{SPACE}]+", -1), lambda w: w != "")
    g = F.floor(h / 10)
    # structs in one-element arrays, so that the words are cut once and not per element
    sized = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda x: F.struct(
        x["w"].alias("w"), x["g"].alias("g"), F.size(x["w"]).alias("n"), (x["g"] % F.size(x["w"])).alias("a")))
    placed = F.transform(sized, lambda x: F.struct(
        x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (F.floor((x["n"] - x["a"]) / (x["g"] % 8 + 3)) + 1).alias("p")))
    repeat = lambda x, i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int")
    again = F.transform(placed, lambda x: F.array_join(F.transform(x["w"], lambda _, i: F.get(x["w"], repeat(x, i))), " "))[0]
    changed = (h % 10 == 0) & col(text).rlike(f"[^{SPACE}]")
    return docs.withColumn(text, F.when(changed, again).otherwise(col(text)))


def _joined(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (the first of equals) and the digests of the runs and of the collapsed text."""
    found = find_runs(docs.select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.when(F.size("runs") > 0, F.concat(_joined(F.col("runs")), F.lit("\n"))).otherwise("")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("best.n * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
