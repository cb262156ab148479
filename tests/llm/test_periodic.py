import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm import periodic
from fieldlake.llm.common import table
from fieldlake.llm.periodic import find_runs, run_digests, runs_of_texts, scan_lags, stable_segments, with_planted_runs

BLANK = r"[^\x20\x09-\x0D]+"


def plain_runs(words):
    """Every maximal stretch per lag, kept unless a smaller lag has it whole."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and not any(q % p == 0 and s <= i and j + q <= s + m for s, m, p in found):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def altered(doc_id, text):
    words = re.findall(BLANK, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = altered(doc_id, text)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rng, size):
    words = []
    while len(words) < size:
        piece = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        words += piece * rng.choice([1, 1, 2, 3, 4, 5, 9]) + piece[: rng.randrange(len(piece))]
    return words


def test_runs_match_plain_search():
    rng = random.Random(3)
    lists = [random_words(rng, rng.randrange(0, 90)) for _ in range(600)]
    for words, (got, runs) in zip(lists, runs_of_texts([" ".join(w).encode() for w in lists])):
        assert [w.decode() for w in got] == words and runs == plain_runs(words), words
        for start, length, period in runs:
            assert smallest_period(words[start : start + length]) == period


def test_splitting_keeps_only_stable_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        codes = rng.zipf(1.5, rng.integers(0, 200)) % 12
        owner = np.sort(rng.integers(0, 3, len(codes)))
        fast = stable_segments(codes, owner)
        slow = [b for t in range(3) if (owner == t).any() for b in periodic._split_slowly(codes.tolist(), int(np.searchsorted(owner, t)), int(np.searchsorted(owner, t, "right")))]
        assert sorted(fast) == sorted(slow)
        for a, b in fast:
            assert b - a >= 6 and np.unique(codes[a:b], return_counts=True)[1].min() >= 4 and owner[a] == owner[b - 1]


def test_long_hard_texts_end():
    assert scan_lags(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert scan_lags(np.tile(np.arange(7), 6_000)) == [(0, 42_000, 7)]
    a, b = [0, 1], [0]
    while len(a) < 30_000:
        a, b = a + b, a
    assert scan_lags(np.array(a)) == []  # Fibonacci words hold no fourth power
    # each level of splitting takes one word off a long segment
    peel = [x for i in range(2000) for x in (i, i + 1, i + 2, i + 3)]
    assert runs_of_texts([" ".join(map(str, peel)).encode()])[0][1] == plain_runs([str(x) for x in peel[:400]])


def test_digests_match_plain_search(spark):
    rng = random.Random(8)
    texts = [" \t\n".join(random_words(rng, rng.randrange(0, 40))) for _ in range(200)] + [None, "", " \n ", "é\x1c" * 9, "x " * 70_000, "a b c " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "y " * 9), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, runs string")
    got = [tuple(r) for r in run_digests(with_planted_runs(docs)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [digest(i, t) for i, t in rows if not (t or "").startswith("x ")]
    assert sorted((r for r in got if r[0] != 204), key=key) == sorted(want, key=key)
    assert next(r for r in got if r[0] == 204)[1] == 1
    whole = find_runs(docs)
    assert whole.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and whole.count() == len(rows)


def test_given_documents(spark):
    docs = table(spark, cases.SF, "documents").select("doc_id", "text")
    got = {r.doc_id: tuple(r) for r in run_digests(with_planted_runs(docs)).collect()}
    some = [r for r in docs.collect() if len(r.text or "") < 4000]
    assert len(some) > 100 and {got[r.doc_id] for r in some} == {digest(r.doc_id, r.text) for r in some}


def test_odd_tables(spark):
    odd = cases.odd_documents(spark)
    assert run_digests(with_planted_runs(odd)).count() == 13
    assert run_digests(with_planted_runs(cases.no_documents(spark))).count() == 0
