"""Native arrays of positions: running sums and the places of regular-expression matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)


def running_sums(values: Column) -> Column:
    """For each element of a bigint array the sum of those before it.

    Sums of blocks are kept, so an array of n elements costs about n * BLOCK steps and not n * n.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK)).cast("int")),
        lambda b: _sum(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))),
    )
    before = F.aggregate(
        blocks, F.array(F.lit(0).cast("bigint")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b))
    )
    whole = lambda i: F.floor(i / BLOCK).cast("int")
    # the sums of the blocks travel with each element through a struct, computed once
    return F.transform(
        F.array(F.struct(values.alias("v"), before.alias("s"))),
        lambda x: F.transform(x["v"], lambda _, i: F.get(x["s"], whole(i)) + _sum(F.slice(x["v"], whole(i) * BLOCK + 1, i % BLOCK))),
    )[0]


def match_spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Places of the leftmost non-overlapping matches, as an array of start, end (code points, end exclusive) and value.

    A text is split at the matches; the lengths of what lies between and of the matches give the places.
    """
    parts = F.struct(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint")).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("bigint")).alias("sizes"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("values"),
    )
    placed = F.transform(F.array(parts), lambda p: F.struct(
        p["gaps"].alias("gaps"), p["sizes"].alias("sizes"), p["values"].alias("values"),
        running_sums(F.transform(p["sizes"], lambda s, i: s + F.get(p["gaps"], i))).alias("before"),
    ))
    found = F.transform(placed, lambda p: F.transform(p["values"], lambda v, i: F.struct(
        (F.get(p["before"], i) + F.get(p["gaps"], i)).alias("start"),
        (F.get(p["before"], i) + F.get(p["gaps"], i) + F.get(p["sizes"], i)).alias("end"), v.alias("value"),
    )))
    return found[0]


def match_contexts(text: Column, pattern: str, width: int) -> Column:
    """Places and values of the matches as in :func:`match_spans`, with up to ``width`` code points ``before`` and ``after`` each.

    The context ends at the neighbouring match's far end, so all contexts together take time in proportion to the text.
    """
    sizes = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    sized = F.transform(F.array(parts), lambda p: F.struct(
        p["between"].alias("between"), p["values"].alias("values"), sizes(p["between"]).alias("gaps"), sizes(p["values"]).alias("sizes"),
    ))
    placed = F.transform(sized, lambda p: F.struct(
        p["between"].alias("between"), p["values"].alias("values"), p["gaps"].alias("gaps"), p["sizes"].alias("sizes"),
        running_sums(F.transform(p["sizes"], lambda s, i: s + F.get(p["gaps"], i))).alias("before"),
    ))
    near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    found = F.transform(placed, lambda p: F.transform(p["values"], lambda v, i: F.struct(
        (F.get(p["before"], i) + F.get(p["gaps"], i)).alias("start"),
        (F.get(p["before"], i) + F.get(p["gaps"], i) + F.get(p["sizes"], i)).alias("end"), v.alias("value"),
        F.substring(F.concat(near(p["values"], i - 1), near(p["between"], i)), -width, width).alias("before"),
        F.substring(F.concat(near(p["between"], i + 1), near(p["values"], i + 1)), 1, width).alias("after"),
    )))
    return found[0]
