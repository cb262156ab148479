"""Small tables with everything that may go wrong, and plain versions of the operators to compare with."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, N_LINES string, score string, row string"
SPACE = " \t\n\x0b\x0c\r"


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = "\n".join(f"line number {i % 50} of the long text" for i in range(4000))
    rows = [
        (1, "Same line here\nother line that is mine", "en", "b", 1), (2, "  SAME LINE HERE \nshort\nshort", "en", "b", 1),
        (2, "  SAME LINE HERE \nshort\nshort", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, "same line here\nand no id", "de", "a", 3), (5, long_text, "en", None, 9), (6, "\n\n\n", "en", "a", 3),
        (7, "ÉÉÉÉÉÉÉÉÉ é\néééééééééÉ é", "fr", "c", 4), (8, "éééééééééé é", "fr", "c", 4), (9, "x" * 40, "en", "c", 4),
        (10, "word " * 30, None, "c", 4), (11, "123 456 !!", "en", "c", 4),
    ]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOC_SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def line_dedup(rows):
    """{(id, row number): (n_lines, n_dropped, kept)}; a null id comes first."""
    def key(line):
        k = line.strip(SPACE)
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = collections.defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def connected(nodes, links):
    """{node: smallest node of its component}."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def leaks(docs, items, width=8, cover=0.5):
    """Pairs of document and item by plain windows of words; right where texts have no slots."""
    at, sizes = collections.defaultdict(set), {}
    for item, text in items:
        words = re.findall(r"\w+", text.lower())
        n = max(1, len(words) - width + 1)
        sizes[item] = n
        for i in range(n):
            at[tuple(words[i : i + width])].add((item, i))
    out = set()
    for doc, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        got = collections.defaultdict(set)
        for i in range(len(words) - width + 1):
            for item, k in at.get(tuple(words[i : i + width]), ()):
                got[item].add(k)
        out |= {(doc, item) for item, ks in got.items() if len(ks) >= cover * sizes[item]}
    return out


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    rank = np.argsort(np.argsort(s, kind="stable"))
    good, bad = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - good * (good - 1) / 2) / (good * bad)
