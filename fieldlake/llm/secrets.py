"""Secret scan: sure spans by pattern, and weak candidates linked into multipart credentials.

Sure parts are assignments to secret names, access identifiers and long hex
runs. Weak parts (named identifiers, secret-looking tokens, endpoints) mean
little alone. They are reported only where complementary parts lie within
``SCOPE`` code points in the same document: an identifier needs a secret, a
secret needs an identifier, an endpoint needs both. The link is an interval join
on (document row, bin of ``SCOPE``): the right side holds, per bin and role, the
first and last start only, which decides exactly whether a part is in reach, so
no pairs are formed however many parts a document has.

Everything is SQL expressions. Only documents that pass a pattern test are split
into spans, and only weak candidates are joined.

Defined cases: a null text is empty and has no spans; repeated rows are scanned
each by itself; rows with a null doc_id are kept; an empty table gives an empty
result; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import col
from fieldlake.llm.spans import match_spans
from fieldlake.session import cut_lineage

SCOPE = 300
KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "secret": "secret", "endpoint": "endpoint"}

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# for these two a run is long enough or fails whole, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:\b(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@._-]{3,})"""
# possessive: a repeated group that may give back would take stack for every label
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?|(?i:\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, kind: str, pattern: str, gate: str | None = None, keep=None) -> Column:
    found = match_spans(text, pattern, 1 if kind in ("assign", "ident") else 0)
    found = F.filter(found, keep) if keep else found
    out = F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")
    ))
    return F.when(text.rlike(gate or pattern), out).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _secret_like(x: Column) -> Column:
    v = x["value"]
    mixed = (F.length(v) >= 20) & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    return mixed | v.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,23}$")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Of parts (row, kind number, start, end) the weak ones whose complements are in reach, per row as an array ``weak``."""
    base = F.col("kind") < 3
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    free = parts.withColumn("_before", F.max(F.when(base, F.col("end"))).over(order)).withColumn(
        "_after", F.min(F.when(base, F.col("start"))).over(back)
    ).filter(base | ((F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))))
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    free = free.select("row", "kind", "start", "end", F.get(roles, F.col("kind")).alias("role"), F.floor(F.col("start") / scope).alias("bin"))
    ends = free.groupBy("row", "role", "bin").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    ends = ends.withColumnRenamed("role", "other").withColumnRenamed("bin", "near")
    weak = free.filter(~base).withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    reach = (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("start") + scope)
    met = weak.join(ends, ["row", "near"]).filter(reach).groupBy("row", "kind", "start", "end", "role").agg(
        F.max(F.col("other") == "secret").alias("secret"), F.max(F.col("other") == "ident").alias("ident")
    )
    needs = F.when(F.col("role") == "ident", F.col("secret")).when(F.col("role") == "secret", F.col("ident")).otherwise(
        F.col("secret") & F.col("ident")
    )
    return met.filter(needs).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))


def scan_secrets(docs: DataFrame, text: str = "text", id_name: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: the id, base (sure spans), weak (linked spans) and spans (both), each in order of start and kind."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(col(id_name).alias(id_name), t.alias("_t"))
    t = F.col("_t")
    base = F.concat(
        _spans(t, "assign", ASSIGN, keep=lambda x: F.length(x["value"]) >= 6), _spans(t, "access", ACCESS), _spans(t, "hex", HEX)
    )
    weak = F.concat(_spans(t, "ident", IDENT), _spans(t, "secret", TOKEN, keep=_secret_like), _spans(t, "endpoint", ENDPOINT))
    found = rows.select(F.monotonically_increasing_id().alias("row"), id_name, F.array_sort(base).alias("base"), weak.alias("maybe"))
    found = cut_lineage(found)  # the row numbers stay as they are from here on
    parts = found.filter(F.size("maybe") > 0).select("row", F.explode(F.concat("base", "maybe")).alias("p")).select("row", "p.kind", "p.start", "p.end")
    out = found.drop("maybe").join(linked(parts, scope), "row", "left")
    out = out.withColumn("weak", F.array_sort(F.coalesce("weak", F.array().cast(SPAN))))
    return out.withColumn("spans", F.array_sort(F.concat("base", "weak"))).drop("row")


def secret_digests(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
