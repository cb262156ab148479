"""Personal data: candidate spans from generous patterns, chosen by boosted trees and calibrated thresholds.

Base spans (e-mail, network address, card, phone) follow from one pattern and one
check per kind and always stay. Around them, generators propose further and
overlapping spans: parts of longer digit runs, grouped and shorter card numbers,
spelled-out addresses, national phone numbers, long network addresses. Each
proposal gets format features (digits, groups, lengths, first digit) and context
features (words and characters on either side), and a hard check (checksum,
parts, digits) that nothing overrules.

Proposals whose nature is sure, by checksum, parts, digit count or the words
around them, vote as labelled rows; the rest have no label. The votes are counted
per distinct feature vector, so the corpus is summed up in a table that no longer
grows once all vectors have been seen, and gradient-boosted trees are fitted on
the ``FIT_VECTORS`` heaviest vectors of the documents that are not held out. Votes of the
held-out documents set one threshold per generator: the lowest score from which
on at least ``PRECISION`` of them are personal data. A generator without enough
held-out votes adds nothing. Accepted proposals that overlap a base span or lie
inside another accepted one are dropped.

Everything is DataFrame and SQL functions and the DataFrame API of MLlib. Spans
are code points, the end exclusive. Patterns are possessive and guarded, so long
runs of any of their pieces take linear time and no stack.

Defined cases: a null text is empty; rows are scanned each by itself, so repeated
and null ids do not meet; without labelled votes only base spans are returned; an
empty table gives an empty table; extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import col, held_back
from fieldlake.llm.spans import match_contexts, match_spans
from fieldlake.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.9
FIT_VECTORS = 20_000  # bound of the rows the trees are fitted on
TREES, DEPTH, STEP = 20, 3, 0.3
BINS = 200
SIDE = 24  # code points of context on either side

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# a match starts where its first run starts or where the last match ended, so no run is read twice
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_AT, _DOT = r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)", r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)"
_END = r"(?![0-9])"
#: (kind, pattern) of each generator
GENERATORS = [
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)*+"),
    ("email", rf"(?<!{LOCAL})[A-Za-z0-9_%+-]++{_AT}{HOST}++(?:{_DOT}{HOST}++)++"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]++(?:\x20?\.\x20?[0-9]++){2,}+"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"),
    ("card", rf"(?<![0-9])[0-9]{{4}}([\x20-])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}{_END}"),
    ("card", rf"(?<![0-9])[0-9]{{4}}([\x20-])[0-9]{{6}}\1[0-9]{{5}}{_END}"),
    ("phone", rf"\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[\x20.-]?[0-9]{{2,4}}){{2}}{_END}"),
    ("phone", rf"\+[0-9]{{1,3}}[\x20.-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:[\x20.-]?[0-9]{{2,4}}){{3,4}}{_END}"),
    ("phone", rf"(?<![0-9+])(?:\([0-9]{{2,5}}\)\x20?|[0-9]{{2,5}}[\x20./-])[0-9]{{3,4}}[\x20.-][0-9]{{3,4}}{_END}"),
]
MAIL_BARE, MAIL_SPELLED, IP_DOTTED, IP_LONG, CARD_SOLID, CARD_GROUPED, CARD_SHORT, PHONE_PLUS, PHONE_PLUS_LONG, PHONE_PLAIN = range(len(GENERATORS))

OWN_WORDS = {
    "email": r"(?i)e-?mail|contact|write|reach|address", "ip": r"(?i)\bip\b|host|server|client|addr|from",
    "card": r"(?i)card|visa|master|amex|credit|payment", "phone": r"(?i)phone|\btel\b|call|fax|mobile|\bcell\b|sms",
}
OTHER_WORDS = r"(?i)order|invoice|version|build|serial|isbn|\bid\b|\bno\.|\bref\b|page|chapter|release"
DATE_LIKE = r"^(?:(?:19|20)[0-9]{2}[-/.\x20][0-9]{1,2}[-/.\x20]|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})"
FEATURES = [
    "generator", "digits", "groups", "distinct", "own_word", "other_word", "char_before", "char_after", "last_group", "first_digit", "size",
    "number_before", "number_after",
]

SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
PROPOSAL = "array<struct<kind:int,start:bigint,end:bigint,fit:boolean,label:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _four_parts(value: Column) -> Column:
    return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")


def _luhn(value: Column, least: int, most: int) -> Column:
    digits = _digits(value)
    return F.length(digits).between(least, most) & F.call_function("luhn_check", digits)


def _sure(text: Column, kind: int, pattern: str, check) -> Column:
    found = match_spans(text, pattern)
    found = F.filter(found, lambda x: check(x["value"])) if check else found
    found = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """The sure spans (kind, start, end) of a text, by kind and start."""
    size = lambda v: F.length(_digits(v))
    checks = [
        (EMAIL, None), (IP, _four_parts), (CARD, lambda v: _luhn(v, 16, 19)), (PHONE, lambda v: size(v).between(8, 15)),
    ]
    return F.array_sort(F.concat(*(_sure(text, kind, pattern, check) for kind, (pattern, check) in enumerate(checks))))


def _judged(g: int, x: Column) -> tuple[Column, Column]:
    """Whether a proposal of generator ``g`` passes the hard check, and its label (null where unsure)."""
    value, digits = x["value"], F.length(_digits(x["value"]))
    named = x["before"].rlike(OWN_WORDS[GENERATORS[g][0]])
    yes, no, open_ = F.lit(1), F.lit(0), F.lit(None).cast("int")
    if g == MAIL_BARE:
        whole = value.rlike(r"\.[A-Za-z]{2,}$")
        return whole, F.when(whole, yes).otherwise(no)
    if g == MAIL_SPELLED:
        marked = value.rlike(r"[\[(]at[\])]") & value.rlike(r"[A-Za-z]{2,}$")
        return value.rlike(r"[A-Za-z]{2,}$"), F.when(marked | (named & value.rlike(" dot ")), yes).when(~value.rlike(r"dot|[\[(]"), no).otherwise(open_)
    if g == IP_DOTTED:
        good = _four_parts(F.regexp_replace(value, " ", ""))
        return good, F.when(_four_parts(value), yes).when(good, open_).otherwise(no)
    if g == IP_LONG:
        letters = value.rlike("[A-Fa-f]")
        return letters | named, F.when(letters, yes).when(value.rlike("^[0-9]{1,2}:"), no).otherwise(open_)
    if g in (CARD_SOLID, CARD_GROUPED, CARD_SHORT):
        good = _luhn(value, 13, 19)
        return good, F.when(good & ((digits >= 16) | named), yes).when(good, open_).otherwise(no)
    dated = value.rlike(DATE_LIKE)
    if g in (PHONE_PLUS, PHONE_PLUS_LONG):
        good = digits.between(8, 15)
        return good, F.when(good, yes).otherwise(no)
    table = x["before"].rlike(r"[0-9][\x20.,;/-]{0,2}$") | x["after"].rlike(r"^[\x20.,;/-]{0,2}[0-9]") | value.rlike(r"^([0-9]{4})[\x20.-][0-9]{4}[\x20.-][0-9]{4}$")
    good = digits.between(9, 15) & ~dated & ~table
    return good, F.when(good & named, yes).when(~good, no).otherwise(open_)


def _side(context: Column, first: bool) -> Column:
    """What stands next to a span: nothing, a blank, a mark, a letter or a digit."""
    at = (lambda c: f"^{c}") if first else (lambda c: f"{c}$")
    return (
        F.when(context == "", 0).when(context.rlike(at(r"[\x20\x09-\x0D]")), 1).when(context.rlike(at("[0-9]")), 4).when(context.rlike(at("[A-Za-z]")), 3).otherwise(2)
    )


def _features(g: int, x: Column) -> dict[str, Column]:
    value, digits = x["value"], _digits(x["value"])
    most = lambda c, n: F.least(c, F.lit(n))
    flag = lambda c: c.cast("int")
    first = F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10))
    return {
        "generator": F.lit(g), "digits": most(F.length(digits), 20), "groups": most(F.size(F.split(value, "[^0-9A-Za-z]+", -1)), 9),
        "distinct": most(F.size(F.array_distinct(F.split(value, ""))), 16), "own_word": flag(x["before"].rlike(OWN_WORDS[GENERATORS[g][0]])),
        "other_word": flag(x["before"].rlike(OTHER_WORDS)), "char_before": _side(x["before"], False), "char_after": _side(x["after"], True),
        "last_group": most(F.length(F.regexp_extract(value, "([0-9A-Za-z]*)$", 1)), 8), "first_digit": first, "size": most(F.length(value), 48),
        "number_before": flag(x["before"].rlike("[0-9]")), "number_after": flag(x["after"].rlike("[0-9]")),
    }


def _proposed(text: Column, g: int, kind: str, pattern: str) -> Column:
    def told(x: Column) -> Column:
        fit, label = _judged(g, x)
        made = {"kind": F.lit(KINDS.index(kind)), "start": x["start"], "end": x["end"], "fit": fit, "label": label, **_features(g, x)}
        return F.struct(*(c.alias(n) for n, c in made.items()))

    found = F.transform(match_contexts(text, pattern, SIDE), told)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(PROPOSAL)).cast(PROPOSAL)


def proposals(text: Column) -> Column:
    """All proposals of a text: kind, start, end, fit (the hard check), label and the features."""
    return F.concat(*(_proposed(text, g, kind, pattern) for g, (kind, pattern) in enumerate(GENERATORS)))


@dataclass
class Redactor:
    """Fitted trees and the least score of each generator that may add spans; without trees nothing is added."""

    trees: GBTClassificationModel | None = None
    thresholds: dict[int, float] = field(default_factory=dict)

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` of proposals with a score."""
        ready = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(rows)
        out = self.trees.transform(ready).withColumn("score", vector_to_array("_chance")[1])
        return out.drop("_vector", "_raw", "_chance", "_side")

    def accepted(self, rows: DataFrame) -> DataFrame:
        """The proposals that pass the hard check and their generator's threshold."""
        if not self.thresholds:
            return rows.limit(0).withColumn("score", F.lit(0.0))
        least = F.lit(None).cast("double")
        for g, t in sorted(self.thresholds.items()):
            least = F.when(F.col("generator") == g, F.lit(t)).otherwise(least)
        return self.scored(rows.filter("fit").filter(F.col("generator").isin(sorted(self.thresholds)))).filter(F.col("score") >= least)


def fit_redactor(rows: DataFrame, precision: float = PRECISION, fit_vectors: int = FIT_VECTORS) -> Redactor:
    """Trees and thresholds from proposals with label, features and ``held`` (kept from the trees, sets the thresholds)."""
    votes = cut_lineage(rows.filter("label is not null").groupBy(*FEATURES, "label", "held").agg(F.count("*").cast("double").alias("weight")))
    heavy = votes.filter("not held").orderBy(F.desc("weight"), *FEATURES, "label").limit(fit_vectors)
    heavy = cut_lineage(heavy)
    if heavy.isEmpty():
        return Redactor()
    # one partition of at most fit_vectors rows in one order: the same trees each time
    ready = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(heavy.coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    trees = GBTClassifier(
        featuresCol="_vector", labelCol="label", weightCol="weight", predictionCol="_side",
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=1, checkpointInterval=-1,
    ).setRawPredictionCol("_raw").setProbabilityCol("_chance").fit(ready.withColumn("label", F.col("label").cast("double")))
    fitted = Redactor(trees)
    bin_ = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    # one row per generator and bin: at most 10 x BINS
    counts = fitted.scored(votes.filter("held")).groupBy("generator", bin_.alias("bin")).agg(
        F.sum(F.col("weight") * F.col("label")).alias("good"), F.sum("weight").alias("all")
    ).collect()
    for g in {r["generator"] for r in counts}:
        good = total = 0.0
        for r in sorted((r for r in counts if r["generator"] == g), key=lambda r: -r["bin"]):
            good, total = good + r["good"], total + r["all"]
            if (good + 1) / (total + 2) >= precision:
                fitted.thresholds[g] = r["bin"] / BINS
    return fitted


def _distinct_spans(base: DataFrame, added: DataFrame) -> DataFrame:
    """Of accepted proposals those that overlap no base span and lie in no other one, per row as an array ``added``."""
    both = base.withColumn("score", F.lit(None).cast("double")).unionByName(added.select("row", "kind", "start", "end", "score"))
    sure = F.col("score").isNull()
    # no base span starts at or before this one's start and ends inside or beyond it, and none starts inside it
    order = Window.partitionBy("row").orderBy("start", F.col("score").isNotNull(), F.desc("end"), F.desc("score"), "kind")
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.col("score").isNotNull(), "end", "score", F.desc("kind"))
    free = both.withColumn("_before", F.max(F.when(sure, F.col("end"))).over(order)).withColumn("_after", F.min(F.when(sure, F.col("start"))).over(back))
    free = free.filter(~sure & (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end")))
    outer = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("score"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    free = free.withColumn("_reach", F.max("end").over(outer)).filter(F.coalesce("_reach", F.lit(-1)) < F.col("end"))
    return free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "score"))).alias("added"))


def find_personal_data(
    docs: DataFrame, text: str = "text", id_name: str = "doc_id", precision: float = PRECISION, keep_text: bool = False,
) -> DataFrame:
    """Per row of ``docs`` the id, base (sure spans), added (chosen proposals, with score) and spans (both), by kind and start."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(id_name).alias(id_name), t.alias("_t"), (held_back(id_name, 5) == 0).alias("held"))
    kept = [F.col("_t")] if keep_text else []
    found = cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("row"), id_name, "held", base_spans(F.col("_t")).alias("base"), proposals(F.col("_t")).alias("maybe"), *kept
    ))  # the row numbers stay as they are from here on
    maybe = found.filter(F.size("maybe") > 0)
    listed = maybe.select("row", "held", F.inline("maybe"))
    chosen = fit_redactor(listed, precision).accepted(listed)
    added = _distinct_spans(maybe.select("row", F.inline("base")), chosen)
    out = found.drop("maybe", "held").join(added, "row", "left")
    out = out.withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:double>>")))
    plain = F.transform("added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.withColumn("spans", F.array_sort(F.concat("base", plain))).drop("row")


def redacted(docs: DataFrame, text: str = "text", id_name: str = "doc_id", precision: float = PRECISION) -> DataFrame:
    """(id, text): texts with every stretch of overlapping spans replaced by its first kind in brackets."""
    found = find_personal_data(docs, text, id_name, precision, keep_text=True).withColumn("row", F.monotonically_increasing_id())
    found = cut_lineage(found.select("row", id_name, "_t", "spans"))
    spans = found.select("row", F.inline("spans"))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")
    runs = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy("row", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind")
    )
    cuts = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    names = F.array(*map(F.lit, KINDS))
    whole = F.transform(F.array(F.struct(F.split("_t", "").alias("c"), F.col("cuts").alias("s"))), lambda x: F.concat(
        F.array_join(F.transform(x["s"], lambda s, i: F.concat(
            _between(x["c"], F.coalesce(F.get(x["s"], i - 1)["end"], F.lit(0)), s["start"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))), ""),
        _between(x["c"], F.element_at(x["s"], -1)["end"], F.size(x["c"])),
    ))[0]
    return found.join(cuts, "row", "left").select(id_name, F.when(F.col("cuts").isNull(), F.col("_t")).otherwise(whole).alias(text))


def _between(chars: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(chars, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), "")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_digests(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )
