import hashlib
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from fieldlake.llm.common import table  # noqa: E402
from fieldlake.llm.personal import GENERATORS, KINDS, base_spans, find_personal_data, personal_digests, proposals, redacted  # noqa: E402
from fieldlake.llm.queries import QUERIES  # noqa: E402

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def digest(doc_id, text):
    spans = plain_spans(text)
    return (doc_id, *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(listed(spans).encode()).hexdigest())


def corpus(rng, n=400):
    """Documents with the usual forms, so that the trees have something to learn from."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    number = lambda k: "".join(rng.choices("0123456789", k=k))

    def card(k=16):
        while True:
            x = "4" + number(k - 1)
            if luhn(x):
                return x

    texts = []
    for i in range(n):
        made = [word() for _ in range(30)]
        item = rng.choice([
            lambda: f"{word()}.{number(2)}@{word()}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: card(),
            lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: number(9), lambda: f"{rng.randrange(20)}.{rng.randrange(30)}.{rng.randrange(9)}", lambda: word(),
        ])
        made.insert(rng.randrange(30), item())
        texts.append(" ".join(made))
    return texts, number, card


def test_base_spans_match_plain_search(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "_d@e.f", "@", ".", "x.y", "-", " ", "+", "(", ")", "1", "22", "255", "256", "0099", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+49 (30) 12", "é", "\n", "378282246310005", "%", "A"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(700)] + [None, "", "1" * 40, "a" * 50 + "@b", "a@" + "b." * 40 + "c", "4111111111111111 " * 300]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    rows = personal_digests(docs).collect()
    assert {tuple(r)[:6] for r in rows} == {digest(i, t) for i, t in enumerate(texts)}
    for r in rows:
        assert set(listed(plain_spans(texts[r.doc_id])).split(",")) - {""} <= set(r.spans.split(","))


def test_parts_of_longer_runs_are_added(spark):
    rng = random.Random(2)
    texts, number, card = corpus(rng)
    phone = "+1 (578) 555-6437"
    joined = [f"abc {phone} {card()} def", f"abc 17.252.227.210 {card()} def"] * 3
    clean = ["no data here at all", "version 1.2.3 of 2020-01-05", "1000 2000 3000 4001", "a table 12 345 678", "serial 4111111111111112 x"]
    rows = [(i, t) for i, t in enumerate([*texts, *joined, *clean])]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    covered = lambda i, s: any(rows[i][1][a.start : a.end] == s for a in found[i].spans)
    for i, t in rows[400:406]:
        assert covered(i, t[-20:-4])  # the card
        assert covered(i, phone) or covered(i, "17.252.227.210")
    for i, _ in rows[406:]:
        assert not found[i].spans
    assert all(0.5 < a.score <= 1 for r in found.values() for a in r.added)
    texts = {r.doc_id: r.text for r in redacted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert texts[400] == "abc [phone] [card] def" and texts[401] == "abc [ip] [card] def" and texts[406] == rows[406][1]


def test_long_runs_of_every_piece(spark):
    pieces = ["a", "a.", "a@", "a@b.", ".b", "1", "1 ", "1-", "1.", "+1 ", "+", "(1) ", "a at b dot ", "1:", "12345678901234567 ", "é"]
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "doc_id int, p string").repartition(8)
    long = docs.select("doc_id", F.concat(F.lit("x@"), F.repeat("p", 30_000)).alias("text"))
    out = long.select("doc_id", F.size(base_spans(F.col("text"))).alias("n"), F.size(proposals(F.col("text"))).alias("m"))
    assert out.count() == len(pieces) and out.filter("n >= 0 and m >= 0").count() == len(pieces)


def test_no_python_in_tasks(spark):
    docs = spark.createDataFrame([(1, "a@b.cc")], "doc_id bigint, text string")
    plan = personal_digests(docs)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)


def test_odd_tables(spark):
    assert personal_digests(cases.no_documents(spark)).count() == 0
    odd = cases.odd_documents(spark)
    assert personal_digests(odd).count() == 13 and redacted(odd).count() == 13
    assert len({k for k, _ in GENERATORS}) == 4


@pytest.mark.skipif(not os.path.isdir(cases.SF), reason="test tables are absent")
def test_given_documents(spark):
    docs = table(spark, cases.SF, "documents").select("doc_id", "text")
    got = {tuple(r)[:6] for r in QUERIES["op11_personal_data"](spark, cases.SF).collect()}
    assert got == {digest(r.doc_id, r.text) for r in docs.collect()}
