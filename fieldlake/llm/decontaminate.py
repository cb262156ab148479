"""Benchmark decontamination by templates: windows of words in which numbers, names and units are typed slots.

Every text is canonicalised word by word: numbers become ``<num>``, units that
follow a number ``<unit>``, capitalised words inside a sentence ``<name>``; what
stood there is the slot's value. Hashes of windows of ``WIDTH`` canonical words
are joined between documents and benchmark items. Windows with fewer than
``MIN_PLAIN`` plain words are too general for slots: they are hashed as the words
that stand there, and match exact copies only. A shorter item is one window of
all its words; documents then have windows of that length, too. An item of fewer
than ``MIN_PLAIN`` words only matches a document that has no other words.

Names are the one slot that spelling decides, so each window also has a hash in
which names stay plain lower-cased words; a text in capitals still meets its item.

Documents meet the items in two steps: a bitmap of fixed size (``BITS`` bits,
however large the benchmark) of the item windows drops windows in the map task;
the windows that are left are joined by hash. A pair of document and item is a
leak when windows with consistent slots cover at least ``MIN_COVER`` of the
item's, or when such windows follow each other over ``MIN_RUN`` words of it at one
alignment, however long the item is. Names are consistent when, at one alignment, a name of the item became
the same name at more than half of its places; windows over its other places
don't count, and none over its places where no name has more than half. Numbers
and units stand for themselves at each place, since equal ones may be
independent. Equal values make it a ``copy``, changed ones ``reparameterised``.

Defined cases: a null or empty text has no windows; repeated rows and rows that share an id are one document, covered
by the windows of all of them; a null id is a document of its own; an empty
benchmark or table gives an empty result; extra columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import col, column_of, grouped, hash_tokens, id_of, segments, texts_of, windows
from fieldlake.session import cut_lineage

WIDTH = 8
MIN_PLAIN = 5
MIN_COVER = 0.5
MIN_RUN = 13  # words
BITS = 1 << 26  # 8 MB
NUMBER = re.compile(
    r"[0-9]+(?:[.,][0-9]+)*|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|hundred|thousand|million"
)
TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d]+(?:\d\w*)?|\w+|[.!?:;\n\"\u201c(\[]")
#: Common units.
UNITS = set(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons tonne tonnes ml l litre "
    "litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years percent dollar dollars euro euros cent cents pound pounds usd eur degree degrees c f k".split()
)
NUM, UNIT, NAME = (np.uint64(x) for x in hash_tokens(["<num>", "<unit>", "<name>"]))
WINDOW_TYPE = "pos int, h bigint, slots array<string>, names array<int>, width int, literal boolean"


class Canonical:
    """The canonical words of some texts, one after the other; ``offsets`` tells where each text's begin.

    ``token`` has the hashes with all slots, ``plain`` those with names as words, ``literal`` those without slots; ``number`` (numbers and units) and ``name`` mark
    the slots, ``value(i)`` is the lower-cased word that stood at i.
    """

    def __init__(self, texts: list[str]):
        lists = [TOKEN.findall(t) for t in texts]
        flat = [w for words in lists for w in words]
        sizes = np.array([len(x) for x in lists], np.int64)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        known = coded.dictionary.to_pylist()
        low = [w.lower() for w in known]
        at = coded.indices.to_numpy(zero_copy_only=False)
        mark = np.array([not (w[0].isalnum() or w[0] == "_") for w in known], bool)[at]
        number = np.array([bool(NUMBER.fullmatch(w)) for w in low], bool)[at]
        unit = np.array([w in UNITS for w in low], bool)[at]
        title = np.array([len(w) > 1 and w[0].isupper() and w[1:].islower() for w in known], bool)[at]
        first = np.zeros(len(at) + 1, bool)
        first[segments(sizes)[:-1]] = True
        first = first[: len(at)]
        after = lambda x: np.concatenate([[False], x[:-1]]) & ~first if len(x) else x
        unit &= after(number) & ~number
        name = title & ~first & ~after(mark) & ~number & ~unit
        literal = hash_tokens(low)[at] if len(at) else np.empty(0, np.uint64)
        plain = np.where(number, NUM, np.where(unit, UNIT, literal))
        words = ~mark
        self.token, self.plain, self.literal = np.where(name, NAME, plain)[words], plain[words], literal[words]
        self.number, self.name = (number | unit)[words], name[words]
        self._at, self._low = at[words], low
        self.offsets = segments(words)[segments(sizes)]

    def value(self, i: int) -> str:
        return self._low[self._at[i]]


def _starts(offsets: np.ndarray, widths: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(owners, starts, window width): all windows of the given widths. Without them those of an item: all of ``WIDTH`` words, or the whole."""
    sizes = np.diff(offsets)
    whole = widths is None
    for n in np.unique(np.minimum(sizes[sizes > 0], WIDTH)) if whole else widths:
        owners = np.flatnonzero(sizes >= n if n == WIDTH or n >= MIN_PLAIN and not whole else sizes == n)
        counts = sizes[owners] - n + 1
        owner = np.repeat(owners, counts)
        yield owner, np.repeat(offsets[owners] - segments(counts)[:-1], counts) + np.arange(counts.sum()), int(n)


def _batch_windows(texts: list[str], wanted: np.ndarray | None, widths: list[int] | None) -> Iterator[tuple[int, int, int, list[str], list[int], int, bool]]:
    """(place of the text, position, hash, slot values, the offset of each in the window if a name, else -1, width, literal) of usable windows; with ``wanted``, of those whose bit is set."""
    for begin, some in grouped(texts):
        words = Canonical(some)
        names = segments(words.name)
        numbers, slots = segments(words.number), segments(words.number | words.name)
        for owner, at, n in _starts(words.offsets, widths):
            few = n - (numbers[at + n] - numbers[at]) < MIN_PLAIN
            for token, slot, use in (
                (words.token, words.number | words.name, n - (slots[at + n] - slots[at]) >= MIN_PLAIN),
                (words.plain, words.number, ~few & (names[at + n] > names[at])),  # windows without names are the same as before
                (words.literal, np.zeros_like(words.number), few),
            ):
                if not use.any():
                    continue
                h = windows(token, n)[at]
                if wanted is not None:
                    use = use & (wanted[(h >> np.uint64(6)) & np.uint64(len(wanted) - 1)] >> (h & np.uint64(63))) & np.uint64(1) == 1
                for k in np.flatnonzero(use):
                    i = at[k]
                    places = [j for j in range(i, i + n) if slot[j]] if slots[i + n] > slots[i] else []
                    values, named = [words.value(j) for j in places], [int(j - i) if words.name[j] else -1 for j in places]
                    yield begin + int(owner[k]), int(i - words.offsets[owner[k]]), int(h[k]), values, named, n, token is words.literal


def template_windows(rows: DataFrame, text: str, key: str, wanted=None, widths: list[int] | None = None) -> DataFrame:
    """(k, pos, h, slots, names, width, literal) of the usable windows of the rows' texts; ``wanted`` is a broadcast bitmap, ``widths`` as in _starts."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else wanted.value
        for batch in batches:
            ids = column_of(batch, "k").to_numpy(zero_copy_only=False)
            found = list(_batch_windows(texts_of(batch, "t"), bits, widths))
            place = np.array([f[0] for f in found], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[place] if len(place) else np.empty(0, np.int64), pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                pa.array(np.array([f[2] for f in found], np.uint64).view(np.int64), pa.int64()),
                pa.array([f[3] for f in found], pa.list_(pa.string())), pa.array([f[4] for f in found], pa.list_(pa.int32())),
                pa.array([f[5] for f in found], pa.int32()), pa.array([f[6] for f in found], pa.bool_()),
            ], names=["k", "pos", "h", "slots", "names", "width", "literal"])

    source = rows.select(id_of(key).alias("k"), col(text).cast("string").alias("t"))
    return source.mapInArrow(explode, "k bigint, " + WINDOW_TYPE)


def _bitmap(items: DataFrame):
    """The item windows' bits, as a broadcast array of ``BITS`` bits."""
    spark = items.sparkSession
    words = BITS // 64
    slot = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    rows = items.select(slot.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _contradictions(met: DataFrame, pair: list[str]) -> DataFrame:
    """Per alignment ``wrong``, the item's places at which a name became another than at more than half of that name's places."""
    named = met.select(*pair, "item_pos", F.explode(F.arrays_zip("names", "item_slots", "slots")).alias("z")).filter("z.names >= 0")
    named = named.select(*pair, (F.col("item_pos") + F.col("z.names")).alias("place"), F.col("z.item_slots").alias("a"), F.col("z.slots").alias("v"))
    became = named.distinct().groupBy(*pair, "a", "v").agg(F.collect_set("place").alias("places"))  # at most the item's length
    name = became.groupBy(*pair, "a").agg(F.sum(F.size("places")).alias("all"), F.collect_list("places").alias("groups"))
    minor = F.flatten(F.filter("groups", lambda g: 2 * F.size(g) <= F.col("all")))
    return name.select(*pair, minor.alias("wrong")).filter(F.size("wrong") > 0).groupBy(*pair).agg(F.flatten(F.collect_list("wrong")).alias("wrong"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_name: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", min_cover: float = MIN_COVER, min_run: int = MIN_RUN,
) -> DataFrame:
    """(doc_id, item_id, n_windows, cover, kind): the items that each document leaks."""
    items = cut_lineage(template_windows(benchmark, item_text, item_id).withColumnsRenamed({"k": "item", "pos": "item_pos", "slots": "item_slots"}))
    template = F.when(~F.col("literal"), F.col("item_pos"))
    sizes = items.groupBy("item").agg(F.countDistinct("item_pos").alias("n_item"), F.countDistinct(template).alias("n_template"))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WIDTH and the lengths of shorter items
    hits = template_windows(docs, text, id_name, _bitmap(items), widths).drop("width", "names", "literal")
    met = hits.join(items, "h").filter(F.size("slots") == F.size("item_slots"))
    met = cut_lineage(met.select("k", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "slots", "item_slots", "names", "width", "literal"))
    pair = ["k", "item", "shift"]
    judged = met.select(*pair, "item_pos", "width", "literal", (F.col("slots") != F.col("item_slots")).alias("changed"))
    judged = judged.join(_contradictions(met, pair), pair, "left")
    inside = lambda x: (x >= F.col("item_pos")) & (x < F.col("item_pos") + F.col("width"))
    judged = cut_lineage(judged.filter(~F.coalesce(F.exists("wrong", inside), F.lit(False))).drop("wrong"))
    runs = judged.filter(F.col("width") == WIDTH).select(*pair, "item_pos").distinct()
    runs = runs.withColumn("run", F.col("item_pos") - F.row_number().over(Window.partitionBy(*pair).orderBy("item_pos")))
    runs = runs.groupBy(*pair, "run").agg(F.count("*").alias("n_run")).groupBy("k", "item").agg(F.max("n_run").alias("n_run"))
    best = judged.groupBy("k", "item").agg(
        F.countDistinct("item_pos").alias("n"), F.countDistinct(template).alias("n_same"), F.max("changed").alias("changed"))
    # where numbers changed, only windows with slots can match: then their own share counts
    cover = F.greatest(F.col("n") / F.col("n_item"), F.coalesce(F.try_divide("n_same", "n_template"), F.lit(0.0)))
    out = best.join(sizes, "item").join(runs, ["k", "item"], "left").withColumn("cover", cover)
    out = out.filter((F.col("cover") >= min_cover) | (F.col("n_run") >= max(min_run - WIDTH + 1, 1)))
    null = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    return out.select(
        null("k").alias("doc_id"), null("item").alias("item_id"), F.col("n").alias("n_windows"), "cover",
        F.when(F.col("changed"), "reparameterised").otherwise("copy").alias("kind"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    id_name = options.get("id_name", "doc_id")
    leaked = find_leaks(docs, benchmark, **options).select(id_of("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, id_of(id_name) == F.col("_leaked"), "left_anti")
