import os
import random
import re
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm import mixing
from fieldlake.llm.queries import QUERIES
from fieldlake.llm.secrets import KINDS, scan_secrets, secret_digests


def test_base_spans_match_plain_search(spark):
    rng = random.Random(4)
    bits = ["password=", "TOKEN : '", "api_key=\"", "apikey=", "AKIA", "ABCDEFGHIJKLMNOP01", "0123456789abcdef", "deadbeef" * 4, " ", "\n", "é", "token=token:abcdefgh", "x", "=", "secret"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(300)] + [None, "", "password=abcdef " * 3000, "ſecret=abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secret_digests(docs).collect():
        spans = cases.base_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == cases.sha(cases.listed(spans))
        assert set(cases.listed(spans).split(",")) - {""} <= set(r.spans.split(","))


def test_weak_parts_need_their_complements(spark):
    token = "Abcdefghij0123456789KL"
    near, far = " x" * 60, " x" * 400
    texts = {
        1: f"user: alice {near} {token}", 2: f"user: alice {far} {token}", 3: f"user: alice {near} https://a.example/login",
        4: f"see https://a.example/x user=bob key {token}", 5: f"commit {token} at https://a.example/x", 6: "login: carol password=hunter22",
        7: f"user: alice{far}", 8: None, 9: f"user: alice {token} " * 500,
    }
    docs = spark.createDataFrame([(k, v, "c") for k, v in [*texts.items(), (1, texts[1])]], "doc_id bigint, text string, spans string")
    found = {}
    for r in scan_secrets(docs).collect():
        kinds = [KINDS[s.kind] for s in r.weak]
        assert found.setdefault(r.doc_id, kinds) == kinds  # repeated rows agree
        for s in r.spans:
            assert (texts[r.doc_id] or "")[s.start : s.end].strip() == (texts[r.doc_id] or "")[s.start : s.end]
    assert found[1] == ["ident", "secret"] and found[2] == [] and found[3] == [] and found[4] == ["endpoint", "ident", "secret"]
    assert found[5] == [] and found[6] == ["ident"] and found[7] == [] and found[8] == [] and found[9] == ["ident", "secret"] * 500
    assert scan_secrets(docs.limit(0)).count() == 0
    assert scan_secrets(cases.odd_documents(spark)).count() == 13


def test_long_runs_of_every_piece(spark):
    pieces = ["a.", "-", "x@", "password=abcdef ", "AKIA", "0f", "user=b ", "https://a", "/", ":1", "host=", "Ab1/", "_", "é", '"', "= "]
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "doc_id bigint, p string").repartition(8)
    for head in ("host=", "user=", "https://"):
        found = scan_secrets(docs.select("doc_id", F.concat(F.lit(head), F.repeat("p", 20_000)).alias("text")))
        assert found.count() == len(pieces)
    one = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(F.lit("user: alice password=hunter22 host="), F.repeat(F.lit("a."), 1_000_000), F.lit("b")).alias("text"))
    assert [KINDS[s.kind] for s in scan_secrets(one).first().spans] == ["ident", "assign", "endpoint"]


def targets(sizes, weights=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = left / (sum(w[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and w[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else w[s] * share for s in names}
        full |= over


def check_mix(rows, texts):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) <= 1e-6 * max(want[s], 1)
        small = min(r.size for r in rows if r.source == s and r.size) if sizes[s] else 0
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], small), (s, taken[s], want[s])


def test_mix_meets_targets_and_reruns_agree(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(cases.SF + "/documents.parquet").collect()}
    rows = QUERIES["op1_mix_sources"](spark, cases.SF).collect()
    assert len(rows) == len(texts)
    check_mix(rows, texts)
    again = QUERIES["op1_mix_sources"](spark, cases.SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_capped_odd_and_empty_tables(spark):
    # the third source is so small that its share stops at three times its size
    rows = [(i, "w " * (5 + i % 7), "a") for i in range(200)] + [(300 + i, "w " * 9, "b") for i in range(100)] + [(500, "w w w w", "c"), (501, None, None), (502, " ", "d")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, source string, target string, Size int")
    got = mixing.mix_sources(docs, slice_rows=50).collect()
    check_mix(got, {r[0]: r[1] for r in rows})
    assert {r.source: r.taken for r in got if r.source in ("c", "d")} == {"c": 12, "d": 0}
    assert mixing.mix_sources(cases.odd_documents(spark)).count() == 13
    assert mixing.mix_sources(cases.no_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_rates_are_nearest_to_one(spark):
    """The tilts solve the dual: words meet targets before rounding, and log rates are linear in size."""
    rows = [(i, "w " * (1 + i % 13), "a" if i % 3 else "b") for i in range(600)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.rate * r.size for r in mine) - mine[0].target) < 1e-4 * mine[0].target
        import math

        slopes = {round(math.log(r.rate) / r.size, 5) for r in mine if r.rate < 3}
        assert max(slopes) - min(slopes) < 2e-5
