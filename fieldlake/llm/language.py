"""Language identification by interpolated Kneser-Ney models of characters.

Texts are lower-cased; whatever isn't a letter is one space. Each language has a
model of ``ORDER`` characters. Counts of character runs are taken from all
training rows, in Arrow batches that emit one row per distinct run; continuation
counts, discounts and interpolated probabilities of all orders are SQL
aggregations over them. A model is a sorted array of 64-bit hashes per order
with log probabilities and back-off weights. Models of more than ``MAX_RUNS`` runs
in some order are not gathered: all their runs stay in tables, only the finished
scores of the most frequent runs go to the executors, and the other runs of the
texts get theirs by joins.

A text gets the language of the lowest cross-entropy per character. The score is
the posterior of that language, with a temperature fitted on calibration rows.
A text is rejected when it lies farther above its language's usual cross-entropy
than that language's calibration texts do, given its length; a language with
fewer than ``FEW`` of them is held to those of all languages together. Texts that
are nearer to another language than to their label don't set limits.

Of the training rows three in four fit the model and all others calibrate. Rows
without text or language train nothing.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
counts as rejected; without any training row all are ``und``; ties go to the
language that is first by name; rows are handled one by one, so repeated rows
and null ids are kept; extra columns are kept unless named like an added one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import col, column_of, held_back, map_arrow, segments
from fieldlake.session import at_most, cut_lineage, shuffled

ORDER = 4
MAX_RUNS = 1_000_000  # of all languages together, per order: bounds what is sent to the executors, not what the models know
FEW = 1000  # calibration texts, of which one in a thousand is left out
CHUNK = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so multiplying is one to one on 64 bits
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
MARGIN = 2.0
SHORT = 60.0

_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """For each code point its letter code: itself below 2**16, 0xFFFF above; a space for what isn't a letter."""
    if not _CLASSES:
        table = np.full(0x110000, 32, np.uint16)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        table[letters] = np.minimum(letters, 0xFFFF)
        _CLASSES.append(table)
    return _CLASSES[0]


def letter_codes(text: str) -> np.ndarray:
    """Codes of the lower-cased text between spaces; runs of non-letters are one space. Empty without letters."""
    pieces = (text[a : a + CHUNK].lower().encode("utf-32-le", "replace") for a in range(0, len(text), CHUNK))
    codes = np.concatenate([np.full(1, 32, np.uint16), *(_classes()[np.frombuffer(x, "<u4")] for x in pieces), np.full(1, 32, np.uint16)])
    gap = codes == 32
    return codes[np.concatenate([[True], ~(gap[1:] & gap[:-1])])] if not gap.all() else np.empty(0, np.uint16)


def runs(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Runs of ``order`` codes packed into 64 bits, the last code lowest."""
    codes = codes.astype(np.uint64)
    n = max(len(codes) - order + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out = (out << np.uint64(16)) | codes[i : i + n]
    return out


def text_runs(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, runs) of the texts with letters; those of a long text come in several parts. A text begins with spaces."""
    for i, text in enumerate(texts):
        codes = letter_codes(text) if text else ()
        if len(codes):
            codes = np.concatenate([np.full(ORDER - 2, 32, np.uint16), codes])
            for a in range(0, len(codes) - ORDER + 1, CHUNK):
                yield i, runs(codes[a : a + CHUNK + ORDER - 1])


# ---- training -------------------------------------------------------------

def count_runs(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, run, c) over all rows; each task emits a run once per language and a few batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(name: str) -> int:
            keys, counts = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            if name in counted:
                keys, at = np.unique(np.concatenate([counted[name][0], keys]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counted[name][1], counts])).astype(np.int64)
            counted[name] = (keys, counts)
            sizes[name] = 0
            return len(keys)

        for batch in batches:
            names = column_of(batch, "l").to_pylist()
            for i, found in text_runs(column_of(batch, "t").to_pylist()):
                name = names[i]
                waiting.setdefault(name, []).append(found)
                sizes[name] = sizes.get(name, 0) + len(found)
                if sizes[name] > 4 * CHUNK and merge(name) > 2 * CHUNK:
                    yield _counted(name, *counted.pop(name))
        for name in list(waiting):
            merge(name)
        for name in counted:
            yield _counted(name, *counted[name])

    source = rows.select(col(lang).cast("string").alias("l"), col(text).cast("string").alias("t"))
    found = source.mapInArrow(run, "lang string, run bigint, c bigint")
    return found.groupBy("lang", "run").agg(F.sum("c").alias("c"))


def _counted(name: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "run", "c"]
    )


def order_tables(top: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Tables of the orders from 1 to ``order``: lang, run, context, p (discounted share), and per context its back-off weight.

    The highest order uses counts, lower ones the numbers of different characters that precede a run.
    """
    tables, counts = [], top
    for n in range(order, 0, -1):
        counts = cut_lineage(counts)
        few = counts.groupBy("lang").agg(F.sum((F.col("c") == 1).cast("bigint")).alias("n1"), F.sum((F.col("c") == 2).cast("bigint")).alias("n2"))
        few = few.withColumn("d", F.greatest(F.lit(0.1), F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5)))).select("lang", "d")
        context = F.shiftrightunsigned("run", 16)
        rows = counts.join(few, "lang").withColumn("context", context)
        totals = rows.groupBy("lang", "context").agg(F.sum("c").alias("all"))
        rows = rows.join(totals, ["lang", "context"])
        rows = rows.select("lang", "run", "context", "c", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("all")).alias("p"))
        tables.insert(0, cut_lineage(rows))
        mask = (1 << (16 * (n - 1))) - 1
        counts = counts.select("lang", F.col("run").bitwiseAND(F.lit(mask)).alias("run")).groupBy("lang", "run").agg(F.count("*").alias("c"))
    return tables


def _frequent(rows: DataFrame, limit: int) -> DataFrame:
    """All runs with at least the count ``c`` that leaves no more than ``limit``."""
    steps = rows.groupBy("c").agg(F.count("*").alias("n"))
    upto = steps.withColumn("up", F.sum("n").over(Window.orderBy(F.desc("c"))))
    least = upto.filter(F.col("up") <= limit).agg(F.min("c")).first()[0]
    return rows.filter(F.col("c") >= (least if least is not None else 1 << 62))


@dataclass
class Model:
    """Sorted hashes per order with, per language, log probabilities of runs and log back-off weights of contexts."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float = -30.0

    def log_probs(self, found: np.ndarray) -> np.ndarray:
        """Per run and language the natural log of the interpolated probability of its last character."""
        out = np.full((len(found), len(self.languages)), np.nan)
        back = np.zeros_like(out)
        for n in range(len(self.keys), 0, -1):
            part = found & np.uint64((1 << (16 * n)) - 1) if n < 4 else found
            at, hit = _place(self.keys[n - 1], part)
            got = np.where(hit[:, None], self.logs[n - 1][at], np.nan) if len(self.keys[n - 1]) else np.full_like(out, np.nan)
            new = np.isnan(out) & ~np.isnan(got)
            out[new] = (back + got)[new]
            if n > 1:
                at, hit = _place(self.contexts[n - 1], part >> np.uint64(16))
                w = np.where(hit[:, None], self.weights[n - 1][at], 0.0) if len(self.contexts[n - 1]) else 0.0
                back = back + w
        rest = np.isnan(out)
        out[rest] = (back + self.unseen())[rest]
        return np.maximum(out, self.floor)

    def unseen(self) -> np.ndarray:
        """What a character has that no order knows."""
        return self.weights[0][0] if len(self.weights[0]) else np.full(len(self.languages), self.floor)


def _hash(x: np.ndarray) -> np.ndarray:
    return x * np.uint64(MULTIPLIER)


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    h = _hash(wanted)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


class LargeModel:
    """Models of any number of runs, as tables: per order the interpolated log probability of each run and language and
    the log back-off weight of each context. ``known`` is a broadcast (hashes, scores) of the most frequent runs."""

    floor = Model.floor

    def __init__(self, tables: list[DataFrame]):
        self.languages = sorted(r.lang for r in tables[0].select("lang").distinct().collect())
        letters = tables[0].select("run").distinct().count() + 1
        self.runs, self.contexts, lower = [], [], None
        for n, table in enumerate(tables, 1):
            weight = F.greatest(1 - F.sum("p"), F.lit(1e-12)) / (letters if n == 1 else 1)
            heads = cut_lineage(table.groupBy("lang", "context").agg(weight.alias("w")))
            rows = shuffled(table).join(heads, ["lang", "context"])
            if lower is None:
                rows = rows.withColumn("q", F.col("p") + F.col("w"))
            else:  # a run's shorter run is in the table of the order below
                rows = shuffled(rows.withColumn("low", F.col("run").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1)))).join(lower, ["lang", "low"])
                rows = rows.withColumn("q", F.col("p") + F.col("w") * F.greatest("q", F.lit(float(np.exp(self.floor)))))
            lower = cut_lineage(rows.select("lang", F.col("run").alias("low"), "q"))
            self.runs.append(self._side_by_side(lower, "low", F.log("q"), f"r{n}", f"q{n}"))
            self.contexts.append(self._side_by_side(heads, "context", F.log("w"), f"h{n}", f"w{n}"))
        self.unseen = [float(x) for x in self.contexts[0].first()["w1"]]
        often = _frequent(tables[-1].groupBy("run").agg(F.sum("c").alias("c")), MAX_RUNS // len(self.languages)).select("run")
        found = self.scores(often).toArrow()
        keys = _hash(found.column("run").to_numpy().view(np.uint64))
        order = np.argsort(keys)
        scores = np.array(found.column("v").combine_chunks().flatten()).reshape(-1, len(self.languages))
        self.known = tables[0].sparkSession.sparkContext.broadcast((keys[order], scores[order]))

    @property
    def value(self) -> LargeModel:
        return self

    def _side_by_side(self, rows: DataFrame, key: str, value: Column, name: str, values: str) -> DataFrame:
        """One row per key with an array over the languages, null where a language has none."""
        cells = F.array(*(F.max(F.when(F.col("lang") == x, value)) for x in self.languages))
        return cut_lineage(rows.groupBy(F.col(key).alias(name)).agg(cells.alias(values)))

    def scores(self, wanted: DataFrame) -> DataFrame:
        """(run, v): per language the log of the interpolated probability of the last character, as ``Model.log_probs`` gives it."""
        rows = wanted
        for n in range(len(self.runs), 0, -1):
            part = F.col("run").bitwiseAND(F.lit((1 << (16 * n)) - 1)) if n < 4 else F.col("run")
            rows = shuffled(rows.withColumns({f"_r{n}": part, f"_h{n}": F.shiftrightunsigned(part, 16)}))
            rows = rows.join(self.runs[n - 1], F.col(f"_r{n}") == F.col(f"r{n}"), "left")
            if n > 1:
                rows = shuffled(rows).join(self.contexts[n - 1], F.col(f"_h{n}") == F.col(f"h{n}"), "left")

        def of(i: int) -> Column:
            tries, back = [], F.lit(0.0)
            for n in range(len(self.runs), 0, -1):
                tries.append(back + F.get(f"q{n}", F.lit(i)))
                if n > 1:
                    back = back + F.coalesce(F.get(f"w{n}", F.lit(i)), F.lit(0.0))
            return F.greatest(F.coalesce(*tries, back + F.lit(self.unseen[i])), F.lit(self.floor))

        return rows.select("run", F.array(*map(of, range(len(self.languages)))).alias("v"))

    def entropies(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with n and h of :func:`entropies`: frequent runs are added up in the tasks, all others by a join."""
        known, size = self.known, len(self.languages)
        rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))  # written, so numbers stay

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, scores = known.value
            for batch in batches:
                ids = column_of(batch, "_row").to_pylist()
                for i, found in text_runs(column_of(batch, "t").to_pylist()):
                    each, counts = np.unique(found, return_counts=True)
                    at, hit = _place(keys, each)
                    total = counts[hit] @ scores[at[hit]] if hit.any() else np.zeros(size)
                    rest, k = each[~hit], int((~hit).sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[i]] * (k + 1), pa.int64()), pa.array([None, *rest.view(np.int64).tolist()], pa.int64()),
                        pa.array([len(found), *counts[~hit].tolist()], pa.int64()), pa.array([total.tolist(), *[None] * k], pa.list_(pa.float64())),
                    ], names=["_row", "run", "c", "s"])

        parts = cut_lineage(rows.select("_row", col(text).cast("string").alias("t")).mapInArrow(run, "_row bigint, run bigint, c bigint, s array<double>"))
        rest = parts.filter("run is not null")
        scored = shuffled(rest.drop("s")).join(cut_lineage(self.scores(rest.select("run").distinct())), "run")
        joined = scored.select("_row", F.lit(0).cast("bigint").alias("n"), F.transform("v", lambda x: x * F.col("c")).alias("s"))
        settled = parts.filter("run is null").select("_row", F.col("c").alias("n"), "s")
        sums = settled.unionByName(joined).groupBy(F.col("_row").alias("_of")).agg(
            F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(size))).alias("s"))
        return shuffled(rows).join(sums, F.col("_row") == F.col("_of"), "left").withColumns({
            "n": F.coalesce("n", F.lit(0)), "h": F.transform("s", lambda x: -x / F.col("n"))}).drop("_row", "_of", "s")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | LargeModel:
    """A model of the rows with text and language."""
    rows = rows.filter(col(text).isNotNull() & col(lang).isNotNull())
    tables = order_tables(count_runs(rows, text, lang))
    if not all(at_most(t, MAX_RUNS) for t in tables):
        return LargeModel(tables)
    parts = [t.select("lang", "run", "context", "p").toArrow() for t in tables]  # at most MAX_RUNS rows each
    languages = sorted({x for part in parts for x in part.column("lang").unique().to_pylist()})
    model = Model(languages, [], [], [], [])
    alphabet = max((len(p.column("run").unique()) for p in parts[:1]), default=1) + 1
    for n, part in enumerate(parts, 1):
        runs_ = part.column("run").to_numpy().view(np.uint64)
        who = np.searchsorted(languages, part.column("lang").to_numpy(zero_copy_only=False).astype(str)) if len(runs_) else np.empty(0, int)
        p = part.column("p").to_numpy()
        contexts = part.column("context").to_numpy().view(np.uint64)
        heads, at = np.unique(contexts, return_inverse=True)
        used = np.zeros((len(heads), len(languages)))
        np.add.at(used, (at, who), p)
        weight = np.maximum(1 - used, 1e-12)
        if n == 1:
            weight = weight / alphabet
        keys, place = np.unique(runs_, return_inverse=True)
        share = np.zeros((len(keys), len(languages)))
        share[place, who] = p
        if n == 1:
            whole = np.where(share > 0, share + (weight[0] if len(weight) else 0), np.nan)
        else:
            low = np.exp(model.log_probs(keys & np.uint64((1 << (16 * (n - 1))) - 1)))
            place_of = np.searchsorted(heads, keys >> np.uint64(16))
            whole = np.where(share > 0, share + weight[place_of] * low, np.nan)
        order, head_order = np.argsort(_hash(keys)), np.argsort(_hash(heads))
        # a context that a language has not seen passes everything on
        model.keys.append(_hash(keys)[order])
        model.logs.append(np.log(whole)[order])
        model.contexts.append(_hash(heads)[head_order])
        model.weights.append(np.log(weight)[head_order])
    return model


# ---- prediction -----------------------------------------------------------

def entropies(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of characters scored, and per language the mean of -log p (nan without letters)."""
    n = np.zeros(len(texts), np.int64)
    total = np.zeros((len(texts), len(model.languages)))

    def flush(part: list[tuple[int, np.ndarray]]) -> None:
        flat = np.concatenate([f for _, f in part])
        distinct, at = np.unique(flat, return_inverse=True)
        scores = model.log_probs(distinct)
        starts = segments(np.array([len(f) for _, f in part]))[:-1]
        owners = np.array([i for i, _ in part])
        for k in range(len(model.languages)):
            np.add.at(total[:, k], owners, np.add.reduceat(scores[at, k], starts))
        np.add.at(n, owners, [len(f) for _, f in part])

    part, size = [], 0
    for i, found in text_runs(texts):
        part.append((i, found))
        size += len(found)
        if size > CHUNK:
            flush(part)
            part, size = [], 0
    if part:
        flush(part)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, -total / n[:, None]


@dataclass
class Calibration:
    """Usual cross-entropy per language, how far above it is still usual, and the temperature of the posterior."""

    usual: dict[str, float]
    limit: dict[str, float]
    temperature: float


def excess(h: Column, usual: Column, n: Column) -> Column:
    """How far a cross-entropy lies above the usual one, less for short texts, which scatter more."""
    return (h - usual) * F.sqrt(n / (n + F.lit(SHORT)))


def calibrate(rows: DataFrame, model, text: str = "text", lang: str = "lang") -> Calibration:
    """Limits from rows of known language: the farthest of all but one in a thousand texts, with a margin."""
    names = model.value.languages
    if not names:
        return Calibration({}, {}, 1.0)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, h = entropies(column_of(batch, "t").to_pylist(), model.value)
        ends = np.arange(0, h.size + 1, len(names), dtype=np.int32)
        return {"n": pa.array(n), "h": pa.ListArray.from_arrays(ends, np.nan_to_num(h).ravel())}

    rows = rows.filter(col(text).isNotNull() & col(lang).isNotNull() & col(lang).isin(names))
    part = rows.select(col(lang).cast("string").alias("l"), col(text).cast("string").alias("t"))
    if isinstance(model, LargeModel):
        scored = model.entropies(part, "t").select("l", "n", "h")
    else:
        scored = map_arrow(part, run, [("n", "bigint"), ("h", "array<double>")], keep=["l"])
    scored = cut_lineage(scored.filter("n > 0"))
    own = F.get("h", F.array_position(F.array(*map(F.lit, names)), F.col("l")).cast("int") - 1)
    scored = scored.withColumn("own", own)
    sure = scored.filter(F.col("own") <= F.array_min("h"))  # a limit is for texts that get the language
    usual = sure.groupBy("l").agg(F.percentile_approx("own", 0.5, 10000).alias("u"))
    above = sure.join(F.broadcast(usual), "l").withColumn(  # one row per language; a shuffle would gather each language in a task
        "x", excess(F.col("own"), F.col("u"), F.col("n")))
    farthest = F.percentile_approx("x", 0.999, 10000).alias("x")
    limits = above.groupBy("l", "u").agg(farthest, F.count("*").alias("n")).collect()  # one row per language
    pooled = above.agg(farthest).first().x
    logs = lambda t: F.transform("h", lambda x: -x * F.col("n") / t)
    loss = lambda t: F.avg(F.log(F.aggregate(logs(t), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(logs(t))))) - (-F.col("own") * F.col("n") / t - F.array_max(logs(t))))
    losses = scored.agg(*(loss(t).alias(str(i)) for i, t in enumerate(TEMPERATURES))).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: losses[i] if losses[i] is not None else 0.0)
    return Calibration(
        {r.l: r.u for r in limits}, {r.l: MARGIN * (r.x if r.n >= FEW else pooled) + 0.2 for r in limits}, TEMPERATURES[best]
    )


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_name: str = "doc_id"):
    """Broadcast model and calibration of training rows."""
    part = held_back(id_name, 16)
    model = fit(docs.filter(part < 12), text, lang)
    model = model if isinstance(model, LargeModel) else docs.sparkSession.sparkContext.broadcast(model)
    return model, calibrate(docs.filter(part >= 12), model, text, lang)


def identify(docs: DataFrame, model, calibration: Calibration, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, lang_score, lang_rejected and lang_entropy; of the old columns those in ``keep`` (all by default)."""

    large = model.languages if isinstance(model, LargeModel) else None
    shared = model if large is None else None

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if large is None:
            languages = shared.value.languages
            n, h = entropies(column_of(batch, text).to_pylist(), shared.value)
        else:
            languages, n = large, column_of(batch, "_n").to_numpy(zero_copy_only=False)
            h = [np.array(x) for x in column_of(batch, "_h").to_pylist()]
        name, score, rejected, entropy = [], [], [], []
        for size, values in zip(n, h):
            if not size or not languages:
                name.append("und")
                score.append(0.0)
                rejected.append(True)
                entropy.append(None)
                continue
            best = int(values.argmin())
            lang = languages[best]
            away = (values[best] - calibration.usual.get(lang, values[best])) * np.sqrt(size / (size + SHORT))
            name.append(lang)
            score.append(float(1 / np.exp(-(values - values[best]) * size / calibration.temperature).sum()))
            rejected.append(bool(away > calibration.limit.get(lang, np.inf)))
            entropy.append(float(values[best]))
        return {
            "lang_pred": pa.array(name, pa.string()), "lang_score": pa.array(score, pa.float64()),
            "lang_rejected": pa.array(rejected, pa.bool_()), "lang_entropy": pa.array(entropy, pa.float64()),
        }

    added = [("lang_pred", "string"), ("lang_score", "double"), ("lang_rejected", "boolean"), ("lang_entropy", "double")]
    if large is None:
        return map_arrow(docs, run, added, keep)
    return map_arrow(_scored(docs, model, text), run, added, [c for c in docs.columns if keep is None or c in keep])


def _scored(docs: DataFrame, model: LargeModel, text: str) -> DataFrame:
    """``docs`` with the columns _n and _h, whatever names it has itself."""
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(col(c).alias(n) for c, n in own.items()))
    made = model.entropies(plain, own[text])
    return made.select(*(F.col(n).alias(c) for c, n in own.items()), F.col("n").alias("_n"), F.col("h").alias("_h"))


def known_language(docs: DataFrame, text: str = "text", lang: str = "lang", id_name: str = "doc_id") -> DataFrame:
    """``docs`` without those that the models, learned from ``docs``, reject."""
    model, calibration = train(docs, text, lang, id_name)
    names = ["lang_pred", "lang_score", "lang_rejected", "lang_entropy"]
    plain = docs.drop(*names)
    return identify(plain, model, calibration, text).filter(~F.col("lang_rejected")).drop(*names)
