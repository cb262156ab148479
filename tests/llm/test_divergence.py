import collections
import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm.divergence import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_docs, top):
    """The report by dictionaries; docs are (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    out = set()
    for lang in {d[1] for d in docs}:
        held, groups = collections.Counter(), collections.defaultdict(collections.Counter)
        for text, _, source in (d for d in docs if d[1] == lang):
            terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
            held.update(set(terms))
            groups[source].update(terms)
        kept = [t for t, n in held.items() if n >= min_docs]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), collections.Counter()))
        for s in groups:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pair), ("term", term)):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows) if part == "pair" or i < top}
    return out


def made(rng, n=240):
    words = ["Straße", "éa", "ÉA", "x", "Zeit", "zeit", "to-day", "a1b", "ß", "日本", "the", "The", "of", "ο", "rare"]
    docs = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "s3", None, "ünı", "empty"])
        text = None if source == "empty" else " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(0, 30)))
        docs.append((text, rng.choice(["en", "en", "de", None]), source))
    return docs + [("only marks 1 2 3", "xx", "p"), ("", "xx", "q"), ("x", "xx", "r")]


def frame(spark, docs):
    rows = [(None if i % 9 == 0 else 7, *d, "clash", 3) for i, d in enumerate(docs)]  # ids repeat and play no part
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, term string, T int")


def test_report_matches_plain_counts(spark):
    docs = made(random.Random(1))
    want = plain(docs, 12, 4)
    assert {tuple(r) for r in divergence(frame(spark, docs), min_docs=12, top=4).collect()} == want
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in want)  # a language without kept terms


def test_colliding_digests_and_small_blocks_change_nothing(spark):
    docs = made(random.Random(2))
    found = divergence(frame(spark, docs), min_docs=12, top=50, digest_bits=2, block_terms=3, block_sources=2)
    assert {tuple(r) for r in found.collect()} == plain(docs, 12, 50)


def test_odd_tables(spark):
    assert divergence(cases.no_documents(spark)).count() == 0
    odd = cases.odd_documents(spark)
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in divergence(odd, min_docs=1).collect()} == plain(rows, 1, 50)
    long = [("lang " * 600_000 + "end", "en", "a"), ("lang", "en", "b")] * 3
    assert {tuple(r) for r in divergence(frame(spark, long), min_docs=3).collect()} == plain(long, 3, 50)
