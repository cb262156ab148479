import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm import minhash, multi_index
from fieldlake.session import cut_lineage
from fieldlake.llm.common import shingle_groups
from fieldlake.llm.decontaminate import Canonical, drop_leaks, find_leaks
from fieldlake.llm.graph import components
from fieldlake.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 199), (199, 200), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == cases.connected({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- near-duplicates ------------------------------------------------------

def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    sampler = minhash.Sampler(400)
    h = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    w = rng.integers(1, 4, len(h)) * 1.1
    a, b = slice(0, 700), slice(150, len(h))
    both = np.minimum(w[150:700], w[150:700]).sum()
    want = both / (w[a].sum() + w[b].sum() - both)
    x, y = sampler.signatures(np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), np.array([700, len(h) - 150]))
    assert abs((x == y).mean() - want) < 0.08


def weighted_pairs(docs, least):
    """All pairs of texts with words whose weighted Jaccard similarity is at least ``least``, weights by plain counts."""
    sets = {i: cases.shingles(t) for i, t in docs}
    df = {}
    for s in sets.values():
        for g in s:
            df[g] = df.get(g, 0) + 1
    n = len(docs)
    weight = {g: 1 + minhash.IDF_SHARE * np.log(n / d) / np.log(max(n, 2)) for g, d in df.items()}
    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    out = set()
    for a, b in {(a, b) for v in held.values() for a in v for b in v if a < b}:
        x, y = sets[a], sets[b]
        both = sum(min(x[g], y[g]) * weight[g] for g in x.keys() & y.keys())
        every = sum(x[g] * weight[g] for g in x) + sum(y[g] * weight[g] for g in y) - both
        if both / every >= least:
            out.add((a, b))
    return out


def test_classes_match_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(MID + "/documents.parquet").collect()]
    rows = QUERIES["op6_minhash_dedup"](spark, MID).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(docs)
    # the counters' noise may move a similarity a little: sure pairs must meet, and no others
    for a, b in weighted_pairs(docs, 0.81):
        assert got[a] == got[b]
    loose = cases.connected([i for i, _ in docs], weighted_pairs(docs, 0.79))
    assert all(loose[i] == loose[c] for i, c in got.items())


def test_a_chain_of_edits_is_one_class_and_odd_rows_are_whole(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows, now = [], list(words)
    for i in range(60):
        rows.append((1000 + i, " ".join(now)))
        now = list(now)
        now[rng.randrange(400)] = f"e{i}"
    rows += [(i, "Only Four Words Here") for i in (5, 6)] + [(7, "only four words"), (8, None), (9, ""), (10, "!!!"), (None, " ".join(words)), (1000, rows[0][1])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, class_id string")
    got = {r.doc_id: r.class_id for r in minhash.duplicate_classes(docs).collect()}
    assert len(got) == 67
    assert all(got[i] is None for i in got if i is None or i >= 1000)  # the null id is the smallest
    assert got[5] == got[6] == 5 and [got[i] for i in (7, 8, 9, 10)] == [7, 8, 9, 10]
    kept = minhash.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [None, 5, 7, 8, 9, 10]))
    assert minhash.duplicate_classes(docs.limit(0)).count() == 0


def test_short_and_wordless_texts_have_one_and_no_shingle():
    (_, words, found), = shingle_groups(["a b c d e f", "a b", "", "?!"])
    assert [len(x) for x in words] == [6, 2, 0, 0] and [len(x) for x in found] == [2, 1, 0, 0]


# ---- embeddings -----------------------------------------------------------

def linked(vectors):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    return links


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    v = np.concatenate([centres + 0.19 * rng.standard_normal((60, 16)) for _ in range(6)] + [centres[:3]] * 4).astype(np.float32).astype(float)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]),
           (907, [float("inf")] * 16), (908, [1e-300] * 16), (0, rows[0][1]), (None, [3.0] * 16)]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<double>, n int")
    got = {r.vec_id: r for r in multi_index.linked_vectors(frame, block_rows=50).collect()}
    links = linked(v)
    parts = cases.connected(range(len(v)), [tuple(map(int, p)) for p in np.argwhere(links)])
    assert np.mean([got[i].n_links == links[i].sum() for i in range(len(v))]) > 0.99
    assert all(got[i].component_id == parts[i] and got[i].kept == (parts[i] == i) for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904, 907))
    assert got[906].component_id == 905 and got[906].n_links == 1
    assert got[908].n_links == 1 and got[908].component_id is None and got[None].kept
    assert multi_index.linked_vectors(frame.limit(0)).count() == 0


def shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if "shuffle_" in f and os.path.exists(f)}


def test_vectors_are_not_copied_to_the_cells_they_visit(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 64)).astype(np.float32)  # no direction stands out: nearly all cells are visited
    v[3000:3500] = v[:500] + 0.02 * rng.standard_normal((500, 64)).astype(np.float32)
    v[5000:5900] = v[7]  # more copies than a block of 20 holds
    ids = [*range(5999), 5000]  # and an id with two vectors
    frame = cut_lineage(spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id bigint, embedding array<float>"))
    before = shuffle_files(spark)
    got = {r.vec_id: r for r in multi_index.linked_vectors(frame, block_rows=20).collect()}
    added = {f: n for f, n in shuffle_files(spark).items() if f not in before}
    assert sum(added.values()) < 6 * v.nbytes
    links = linked(v.astype(float))
    assert all(got[i].n_links == links[i].sum() for i in range(5000) if not links[i, 5999])
    parts = cases.connected(range(5999), [(int(a), int(b)) for a, b in np.argwhere(links) if b < 5999])
    assert all(got[i].component_id == parts[i] for i in range(5000) if not links[i, 5999])


def test_registered_query_reaches_brute_force(spark):
    table = spark.read.parquet(cases.SF + "/embeddings.parquet").collect()
    links = linked(np.array([r.embedding for r in table], float))
    got = {r.vec_id: r for r in QUERIES["op8_multi_index"](spark, cases.SF).collect()}
    assert [got[r.vec_id].n_links for r in table] == links.sum(1).tolist()


def test_every_true_pair_lies_in_visited_cells_of_a_fine_grid():
    rng = np.random.default_rng(4)
    u = rng.standard_normal((4000, 8)) @ rng.standard_normal((8, 384)) + 0.01 * rng.standard_normal((4000, 384))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    far = rng.standard_normal((4000, 8)) @ np.linalg.svd(u, full_matrices=False)[2][:8]  # neighbours differ inside the subspace
    far -= (far * u).sum(1, keepdims=True) * u
    v = 0.9501 * u + np.sqrt(1 - 0.9501**2) * far / np.linalg.norm(far, axis=1, keepdims=True)
    grid = multi_index.Grid(u, 64, 0.95)
    home, visited = grid.cells(v), [set(grid.visits(b)) for b in grid.bounds(u)]
    assert all(c in s for c, s in zip(home, visited))
    home, visited = grid.cells(u), [set(grid.visits(b)) for b in grid.bounds(v)]
    assert all(c in s for c, s in zip(home, visited))
    assert np.mean([len(s) for s in visited]) < 0.5 * 64 * 64
    # equal codewords
    same = multi_index.Grid(np.repeat(u[:1], 20, 0), 4, 0.95)
    assert all(len(same.visits(b)) == 16 for b in same.bounds(u[:1]))


def test_forest_spans_the_links():
    m = np.zeros((3, 4), bool)
    m[0, 0] = m[0, 2] = m[1, 1] = m[1, 2] = m[2, 3] = True
    rows, columns = multi_index.forest(m)
    assert rows.tolist() == [0, 0, 2] and columns.tolist() == [0, 0, 0, 2]


# ---- leaks ----------------------------------------------------------------

def test_slots():
    c = Canonical(["Yesterday Anna ran 5 km. Bob walked three miles"])
    assert [c.value(i) for i in np.flatnonzero(c.name)] == ["anna"]
    assert [c.value(i) for i in np.flatnonzero(c.number)] == ["5", "km", "three", "miles"]


def test_reparameterised_questions(spark):
    item = "A train leaves the station with Anna at 5 km per hour and later Anna stops after 7 miles because the 5 signals were all red today"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny question here"), (5, "these plain words are enough")], "item_id bigint, text string")
    say = lambda t: f"some words before the passage {t} and some after it"
    texts = {
        1: item.upper(), 2: say(item.replace("Anna", "Berta").replace("5", "12").replace("7", "3.5")), 3: say(item.replace("Anna", "Berta", 1)),
        4: say(item), 5: None, 6: "", 7: "Nothing of that kind is said in this text at all, nor later", 8: "A tiny question here, and these plain words; are enough!", 9: say(item.lower()),
        10: say("x".join(item.split(" ", 12)[:12])),
    }
    docs = spark.createDataFrame([(k, v, "c") for k, v in [*texts.items(), (4, texts[4]), (None, item)]], "doc_id bigint, text string, kind string")
    got = {(r.doc_id, r.item_id): r.kind for r in find_leaks(docs, items).collect()}
    assert got.pop((8, 5)) == "copy"
    assert got == {(1, 1): "copy", (2, 1): "reparameterised", (4, 1): "copy", (9, 1): "copy", (None, 1): "copy"}
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 10]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(cases.odd_documents(spark), items).count() == 0


def pairs(spark, items, docs):
    frame = lambda x, k: spark.createDataFrame(list(enumerate(x)), f"{k} bigint, text string")
    return {(r.doc_id, r.item_id): r.kind for r in find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}


def test_a_contradiction_removes_only_its_windows(spark):
    boys = "the teacher asked 3 boys and 3 girls to share every apple that they had found under the tree"
    name = "we know that Anna went to the market because she needed bread and milk while Anna had no money left after the long holidays with all of her family so Anna went home again"
    docs = [boys.replace("3", "4", 1).replace("3", "5"), name.replace("Anna", "Berta", 1), name[::-1]]
    assert pairs(spark, [boys, name], docs) == {(0, 0): "reparameterised", (1, 1): "copy"}


def test_windows_full_of_slots_and_few_words_are_found_as_copies(spark):
    dense = "What is 12 times 7 plus 30"
    mixed = "add 3 kg 4 kg 5 kg 6 kg 7 kg to the load of the old truck before it leaves"
    docs = [f"Question: {dense} please", dense.replace("12", "13"), mixed.replace("6", "9"), "Who ran?", "who ran? nobody knows that"]
    assert pairs(spark, [dense, mixed, "Who ran"], docs) == {(0, 0): "copy", (2, 1): "copy", (3, 2): "copy"}


def test_a_long_quote_of_a_longer_item_is_a_leak(spark):
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ax", "ex", "ix", "ox", "ux", "yx")][:59]
    say = lambda a, b: "some other words " + " ".join(words[a:b]) + " and then some more"
    assert pairs(spark, [" ".join(words)], [say(10, 40), say(10, 23), say(10, 22)]) == {(0, 0): "copy", (1, 0): "copy"}


def test_leaks_match_plain_windows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(MID + "/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(MID + "/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontaminate"](spark, MID).collect()}
    assert got == cases.leaks(docs, items)


# ---- pipeline -------------------------------------------------------------

def test_pipeline_matches_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(cases.SF + "/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(cases.SF + "/benchmark.parquet").collect()]
    kept = [(i, t) for i, _, _, t in cases.line_dedup([(r.doc_id, r.text) for r in docs.collect()])]  # no document is rejected
    parts = cases.connected([i for i, _ in kept], weighted_pairs(kept, minhash.SIMILARITY))
    kept = [(i, t) for i, t in kept if parts[i] == i]
    gone = {d for d, _ in cases.leaks(kept, items)}
    kept = {i: t for i, t in kept if i not in gone}
    rows = corpus_pipeline.run(spark, cases.SF).collect()
    sizes = {i: len((t or "").split()) for i, t in kept.items()}
    assert {r.doc_id for r in rows} <= set(kept) and all(r.size == sizes[r.doc_id] and r.taken == r.copies * r.size > 0 for r in rows)
    assert sum({r.source: r.source_size for r in rows}.values()) == sum(sizes.values())
    taken, target = {}, {r.source: r.target for r in rows}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 60) for s in taken)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
