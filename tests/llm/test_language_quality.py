import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from fieldlake.llm import language, quality
from fieldlake.llm.queries import QUERIES
from fieldlake.session import cut_lineage

MID = "/root/testdata/sf0.01"


# ---- language -------------------------------------------------------------

def kneser_ney(texts, order):
    """Interpolated probabilities by plain dictionaries: {run: p of its last letter}, as the library's hashed tables have them."""
    import collections

    top = collections.Counter(int(r) for t in texts for _, found in language.text_runs([t]) for r in found)
    tables = [None] * (order + 1)
    counts = top
    for n in range(order, 0, -1):
        tables[n] = counts
        counts = collections.Counter(r & ((1 << 16 * (n - 1)) - 1) for r in counts)
    letters = len(tables[1]) + 2  # one of them is only in the other language, one stands for those never seen

    def p(run, n):
        c = tables[n]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)
        context = run >> 16
        same = {r: v for r, v in c.items() if r >> 16 == context}
        if not same:
            return p(run & ((1 << 16 * (n - 1)) - 1), n - 1)
        total = sum(same.values())
        left = 1 - sum(max(v - d, 0) / total for v in same.values())
        lower = 1 / letters if n == 1 else p(run & ((1 << 16 * (n - 1)) - 1), n - 1)
        return max(c.get(run, 0) - d, 0) / total + left * lower

    return p


def test_model_is_interpolated_kneser_ney(spark):
    texts = ["abracadabra abba", "banana bandana", "cab dab"]
    docs = spark.createDataFrame([(t, "xx") for t in texts] + [("zzz", "yy"), (None, "xx"), ("abc", None)], "text string, lang string")
    model = language.fit(docs)
    p = kneser_ney(texts, language.ORDER)
    runs = np.concatenate([f for _, f in language.text_runs(["abracadabra band qqq cadab"])])
    got = np.exp(model.log_probs(runs)[:, model.languages.index("xx")])
    assert np.allclose(got, [p(int(r), language.ORDER) for r in runs], rtol=1e-6)


def test_pieces_of_a_long_text_are_its_runs(spark, monkeypatch):
    text = "Straße über-all 12 İé " * 50
    whole = np.concatenate([f for _, f in language.text_runs([text])])
    monkeypatch.setattr(language, "CHUNK", 37)
    assert (np.concatenate([f for _, f in language.text_runs([text])]) == whole).all()


def test_languages_of_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(MID + "/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, MID).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(out) > 0.98 and np.mean([r.rejected for r in rows]) < 0.01


def test_odd_texts_and_rejection(spark):
    docs = spark.read.parquet(MID + "/documents.parquet")
    model, calibration = language.train(docs)
    odd = cases.odd_documents(spark).unionByName(spark.createDataFrame(
        [(90, "Привет как дела сегодня хорошо и завтра", None, None, 1), (91, "xqzj wvkq zzxq jqvw " * 20, None, None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        allowMissingColumns=True).withColumn("LANG_PRED", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(odd, model, calibration).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 6, 11} and got[3].lang_score == 0
    assert got[90].lang_rejected and got[91].lang_rejected
    assert language.identify(cases.no_documents(spark), model, calibration).count() == 0
    assert {r.lang_pred for r in language.identify(odd, *language.train(cases.no_documents(spark))).collect()} == {"und"}
    assert language.known_language(docs).count() == docs.count()  # clean documents stay


@pytest.mark.parametrize("limit", [40, 300])
def test_models_beyond_the_limit_lose_no_run(spark, monkeypatch, limit):
    docs = spark.read.parquet(MID + "/documents.parquet").filter("doc_id % 9 = 0").select("doc_id", "text", "lang")
    odd = docs.unionByName(spark.createDataFrame([(None, None, "xx"), (-1, "12 34", None), (-1, "qqq żółw", None), (-1, "qqq żółw", None)], docs.schema))
    shown = lambda: sorted((tuple(r) for r in language.identify(odd, *language.train(docs), keep=["doc_id"]).collect()), key=str)
    whole = shown()
    monkeypatch.setattr(language, "MAX_RUNS", limit)
    assert isinstance(language.fit(docs), language.LargeModel)
    cut = shown()
    assert [r[:2] + r[3:4] for r in cut] == [r[:2] + r[3:4] for r in whole]
    assert np.allclose([r[2] for r in cut], [r[2] for r in whole], atol=1e-6)
    assert np.allclose([r[4] or 0 for r in cut], [r[4] or 0 for r in whole], rtol=1e-9)


def test_mislabelled_rows_of_one_language_leave_rejection_on(spark):
    rng = np.random.default_rng(6)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))
    rows = [(say("abcde"), "aa") for _ in range(1200)] + [(say("mnopq"), "bb") for _ in range(1200)]
    rows += [(say("abcгд"), "aa") for _ in range(6)]  # 0.5 % of that language, in a script that no model has
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = spark.sparkContext.broadcast(language.fit(docs.limit(2400).filter("text rlike '^[a-z ]+$'")))
    limits = language.calibrate(docs, model).limit
    assert limits["bb"] < 1 < limits["aa"]


def two_languages(spark, n, common):
    """``n`` texts of few letters: ``common`` of 100 in 'aa', one in 100 of these with letters that no model has; the others in 'bb', clean."""
    pick = lambda letters, salt: F.substring(F.lit(letters), (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(5)) + 1).cast("int"), F.lit(1))
    say = lambda letters: F.concat(*(F.lit(" ") if i % 4 == 3 else pick(letters, i) for i in range(48)))
    docs = spark.range(n).withColumnRenamed("id", "doc_id")
    first = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(100)) < common
    strange = F.pmod(F.xxhash64("doc_id", F.lit(98)), F.lit(100)) == 0
    text = F.when(first & strange, say("abcгд")).when(first, say("abcde")).otherwise(say("mnopq"))
    return docs.select("doc_id", text.alias("text"), F.when(first, "aa").otherwise("bb").alias("lang"))


def test_all_held_out_rows_calibrate(spark):
    docs = cut_lineage(two_languages(spark, 46_000, 96))  # about 1840 of 'bb': of any 20000 rows fewer than FEW
    n = docs.filter("lang = 'bb'").count()
    assert n * 20_000 / 46_000 < language.FEW < n
    model = spark.sparkContext.broadcast(language.fit(docs.filter("text rlike '^[a-z ]+$'").limit(3000)))
    limits = language.calibrate(docs, model).limit
    assert limits["bb"] < 1 < limits["aa"]


def test_known_language_learns_limits_from_all_held_out_rows(spark):
    docs = two_languages(spark, 120_000, 96).filter("text rlike '^[a-z ]+$' or crc32(cast(doc_id as string)) % 16 >= 12")
    odd = docs.filter("lang = 'bb' and crc32(cast(doc_id + 1000000 as string)) % 16 >= 12").limit(1).select(  # fits no model
        (F.col("doc_id") + 1_000_000).alias("doc_id"), F.translate("text", "opq", "вгд").alias("text"), "lang")
    docs = cut_lineage(docs.unionByName(odd))
    kept = language.known_language(docs)
    assert kept.filter("doc_id >= 1000000").count() == 0
    assert kept.filter("lang = 'bb'").count() > 0.99 * docs.filter("lang = 'bb'").count()


# ---- quality --------------------------------------------------------------

def test_risk_gradient_and_clamp():
    rng = np.random.default_rng(0)
    p, u, w = rng.random((40, 5)), rng.random((60, 5)), rng.standard_normal(5)
    risk, g = quality.risk_gradient(p, u, w, 0.3)
    for j in range(5):
        step = np.eye(5)[j] * 1e-6
        assert abs((quality.risk_gradient(p, u, w + step, 0.3)[0] - risk) / 1e-6 - g[j]) < 1e-4
    # unlabelled rows that all look like positives make the negative part fall below zero: it is then undone
    hard = quality.risk_gradient(p, p, w * 0 + 5, 1.0 + 1e-3)
    assert hard[0] >= 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(0, 1, (n, 3))
    u = np.vstack([good(2800), rng.normal(4, 1, (1200, 3))])
    scorer = quality.fit(good(3000), u)
    assert abs(scorer.prior - 0.7) < 0.06
    assert scorer.scores(good(500)).mean() > 0.9 and scorer.scores(rng.normal(4, 1, (500, 3))).mean() < 0.1


def test_quality_of_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(MID + "/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert cases.auc([truth[r.doc_id] for r in own], [r.score for r in own]) > 0.95
    assert np.mean([r.predicted for r in own if truth[r.doc_id] == 1]) > 0.97


def test_quality_with_every_row_labelled(spark):
    """Rows labelled 0 belong to the unlabelled mixture, so there is something to learn from; repeated ids count once."""
    rng = np.random.default_rng(3)
    words = ["the", "rain", "falls", "on", "green", "hills", "and", "rivers"]
    rows = [(i, " ".join(rng.choice(words, 40)) + "." if i % 2 else "$$$ !!! BUY 1234 " * 10, i % 2) for i in range(400)] + [(1, "the rain", 1)] * 500
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]], "doc_id bigint, quality int")
    found = quality.quality_scores(docs, labels).collect()
    own = [r for r in found if r.held_out]
    assert cases.auc([r.doc_id % 2 for r in own], [r.score for r in own]) > 0.95 and {r.predicted for r in own} == {0, 1}


def test_quality_of_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (7, None), (9, 1), (10, 1)], "doc_id bigint, quality int")
    rows = quality.quality_scores(cases.odd_documents(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(cases.no_documents(spark), labels).count() == 0
    alone = quality.quality_scores(cases.odd_documents(spark), labels.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}
