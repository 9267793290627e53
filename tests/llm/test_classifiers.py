import math
import random

import numpy as np
from edges import ALL_IDS, edge, empty, ids

from millrace.llm import gbdt, langid, quality, toxicity


def rows_of(spark, n=600):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(n):
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        if rude:
            for at in rng.sample(range(len(words)), 4):
                words[at] = rng.choice(["blergo", "zlorp", "vexxit"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words), "xx" if k % 2 else "yy", "s"))
        labels.append((k, int(not bad), int(rude)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality(spark):
    docs, labels = rows_of(spark)
    model = quality.fit(docs, labels)
    assert accuracy(quality.score(docs, model).collect(), labels, "quality") > 0.97
    rows = quality.score(edge(spark), model).collect()
    assert ids(rows) == ALL_IDS and len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
    assert quality.score(empty(spark), model).count() == 0


def test_toxicity_learns_words_that_no_list_has(spark):
    docs, labels = rows_of(spark)
    model = toxicity.fit(docs, labels)
    assert {"blergo", "zlorp", "vexxit"} <= model.lexicon.words.keys()
    assert accuracy(toxicity.score(docs, model).collect(), labels, "toxic") > 0.97
    assert ids(toxicity.score(edge(spark), model).collect()) == ALL_IDS
    kept = toxicity.accepted(edge(spark), model)
    assert kept.columns == edge(spark).columns and ids(kept.collect()) == ALL_IDS


def test_held_out_labels_are_never_learned(spark):
    docs, labels = rows_of(spark, 300)
    from millrace.llm.common import held_out

    wrong = labels.withColumn("toxic", (labels.toxic * 0 + 1)).filter(held_out("doc_id")).unionByName(labels.filter(~held_out("doc_id")))
    a = sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, labels)).collect()))
    assert a == sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs.repartition(5), wrong)).collect()))


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, nulls):
        for m, name in ((quality, "quality"), (toxicity, "toxic")):
            rows = m.score(edge(spark), m.fit(edge(spark), labels, label=name)).collect()
            assert ids(rows) == ALL_IDS and len({r.score for r in rows}) == 1
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), none)).count() == 0


def test_trees_fit_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = gbdt.fit_calibrated(x, y)
    fresh = rng.normal(size=(500, 3))
    assert ((model.score(fresh) > 0.5) == ((fresh[:, 0] > 0) != (fresh[:, 1] > 0))).mean() > 0.95


def test_batches_go_down_trees_as_single_rows_do():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4)).round(1)
    model = gbdt.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float), trees=25)
    fresh = np.concatenate([rng.normal(size=(60, 4)).round(1), np.full((1, 4), np.nan)])
    for row, got in zip(fresh, model.raw(fresh), strict=True):
        want = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
            want += leaf[at - len(feature)]
        assert abs(got - want) < 1e-9


def test_a_tree_splits_where_the_log_loss_falls_most():
    """The root of the first tree against trying every feature and cut."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = (rng.random(400) < np.where(x[:, 1] > 6, 0.8, 0.25)).astype(float)
    model = gbdt.fit(x, y, trees=1, depth=1, least=10)
    p = np.full(400, (y.sum() + 0.5) / 401)
    grad, hess, best = p - y, p * (1 - p), (0.0, None, None)
    part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1.0)
    for f in range(3):
        for cut in np.unique(x[:, f]):
            right = x[:, f] > cut
            if min(right.sum(), (~right).sum()) >= 10:
                best = max(best, (part(right) + part(~right) - part(np.ones(400, bool)), f, cut))
    f, threshold = int(model.feature[0, 0]), model.threshold[0, 0]
    assert f == best[1] and ((x[:, f] > threshold) == (x[:, f] > best[2])).all()
    for side, leaf in ((x[:, f] > threshold, model.leaf[0, 1]), (x[:, f] <= threshold, model.leaf[0, 0])):
        assert abs(leaf + 0.15 * grad[side].sum() / (hess[side].sum() + 1.0)) < 1e-9


def test_features_of_statistics_by_plain_counting():
    text = "One two two. THREE!! a | b ...\nOne two two. THREE!! a\nnew line 42"
    words = text.split()
    got = quality.statistics([text, "", None or ""])
    assert abs(got[0, 2] - len(set(words)) / len(words)) < 1e-12
    assert abs(got[0, 3] - len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / (len(words) - 1)) < 1e-12
    assert abs(got[0, 8] - text.count("!") / len(words)) < 1e-12 and got[0, 12] == max(map(len, words))
    assert not got[1].any() and (got[1] == got[2]).all()


def test_calibration_sees_no_label_of_its_own_fold(spark):
    """Words of one toxic document each, and labels by chance: an honest calibration can't tell, whatever lexicons learned."""
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(900):
        rude = rng.random() < 0.4
        marks = [f"rare{rng.randrange(60)}" for _ in range(3)] if rude else []
        docs.append((k, " ".join([rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(400)) for _ in range(25)] + marks)))
        labels.append((k, int(rng.random() < 0.4)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(df, truth)
    rows = toxicity.score(df, model).collect()
    assert np.mean([r.score for r in rows]) < 0.6 and max(model.trees.levels, default=0.4) < 0.9


def test_held_out_accuracy_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for rows, name, least in ((toxicity.score(docs, toxicity.fit(docs, labels)), "toxic", 0.95), (quality.score(docs, quality.fit(docs, labels)), "quality", 0.95)):
        truth = {r.doc_id: r[name] for r in labels.collect()}
        held = [(r.predicted, truth[r.doc_id]) for r in rows.collect() if r.held_out and r.doc_id in truth]
        assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > least
    rows = [r for r in langid.predict(docs, langid.fit(docs)).collect() if r.held_out]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.98


def test_language_counts_and_priors(spark):
    """The learned matrix against counting every n-gram of every document that isn't held out."""
    from zlib import crc32

    rows = [(k, t, lang) for k, (t, lang) in enumerate([("Ab c", "x"), ("ba", "y"), ("Zé zé", "x"), (None, "x"), ("q", None), ("aab", "y"), ("bb", "x"), ("ccc", "y")] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts, docs = np.full((2, langid.BUCKETS), 0.5), np.zeros(2)
    for k, t, lang in rows:
        if t is not None and lang is not None and crc32(str(k).encode()) % 5:
            two, three, bounds, _ = langid.hashed_ngrams([f"  {t.lower()}  "])
            for grams in (two, three):
                np.add.at(counts["xy".index(lang)], grams[bounds[0][0] : bounds[0][1]], 1)
            docs["xy".index(lang)] += 1
    assert model.langs == ["x", "y"]
    assert np.allclose(model.log_prior, np.log(docs / docs.sum())) and np.allclose(model.log_prob, np.log(counts / counts.sum(1, keepdims=True)))


def test_isotonic_is_pool_adjacent_violators():
    knots, levels = gbdt.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 0, 1]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all() and 0 < levels[0] < levels[-1] < 1


def test_language(spark):
    docs, _ = rows_of(spark, 200)
    docs = docs.withColumn("text", docs.text.substr(1, 0)).unionByName(docs)
    from pyspark.sql import functions as F

    docs = docs.withColumn("text", F.when(F.col("lang") == "xx", F.translate(F.lower("text"), "etaoin", "kwzyxj")).otherwise(F.col("text")))
    model = langid.fit(docs)
    assert model.langs == ["xx", "yy"]
    rows = langid.predict(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    full = [r for r in rows if r.lang_pred != "und"]
    assert len(full) == 200 and all(r.lang_pred == truth[r.doc_id] for r in full)
    edges = langid.predict(edge(spark), model).collect()
    assert ids(edges) == ALL_IDS
    assert {r.doc_id for r in edges if r.lang_pred == "und"} == {2, 3, 4}
    assert langid.fit(empty(spark)).langs == [] and langid.predict(empty(spark), model).count() == 0
    assert {r.lang_pred for r in langid.predict(edge(spark), langid.fit(empty(spark))).collect()} == {"und"}


def test_language_score_is_the_plain_sum():
    """Gathered batch scores against counting n-grams one by one, for texts cut anywhere."""
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.log(rng.dirichlet(np.ones(langid.BUCKETS), 3)), np.log(np.array([0.2, 0.3, 0.5])))
    texts = ["x", "Hello, world", "", None, "ñandú 12 grün", "abc " * 50]
    together = model.score(texts)
    for chunk in (5, 1_000_000):
        langid.CHUNK = chunk
        for k, t in enumerate(texts):
            lang, score = model.score([t])
            assert lang[0] == together[0][k] and abs(score[0] - together[1][k]) < 1e-6
    total = model.log_prior.copy()
    two, three, _, _ = langid.hashed_ngrams([f"  {texts[1].lower()}  "])
    for k in range(len(two)):
        total += model.log_prob[:, two[k]] + model.log_prob[:, three[k]]
    assert together[0][1] == model.langs[int(total.argmax())]


def test_slices_of_languages_give_what_one_matrix_gives(spark, monkeypatch):
    """Eleven labels, most of them junk, in one slice and in six."""
    words = ["abc def", "Ghi", "xyz", "zé ñandú", "", None, "12 34", "abcx " * 30]
    rows = [(k, words[k % len(words)], "x" if k % 3 else "y") for k in range(40)] + [(100 + k, f"ghi {k * 'jk'}", f"junk{k}") for k in range(9)]
    rows += [(200, "no label", None), (None, "no id", "x"), (5, "abc", "y"), (5, "abc", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    whole = sorted(map(tuple, langid.predict(df, model).collect()), key=str)
    assert not model.further and len(model.langs) > 6
    monkeypatch.setattr(langid, "SLICE_LANGS", 2)
    cut = langid.fit(df)
    assert cut.langs == model.langs[:2] and 2 * len(cut.further) + 2 >= len(model.langs) > 2 * len(cut.further)
    parts = sorted(map(tuple, langid.predict(df, cut).collect()), key=str)
    assert len(parts) == len(rows) and [r[:3] for r in parts] == [r[:3] for r in whole]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(parts, whole, strict=True))


def test_ties_between_slices_go_to_the_first_language():
    row = np.log(np.full((1, langid.BUCKETS), 1 / langid.BUCKETS))
    one, two = (langid.Model([x], row, np.log(np.array([0.5]))) for x in "ab")
    both = langid.Model(["a", "b"], np.concatenate([row, row]), np.log(np.array([0.5, 0.5])))
    texts = ["hello", "", None, "7"]
    lang, _, mass = langid.better(one.parts(texts), two.parts(texts))
    assert lang == ["a", "und", "und", "und"] and langid.shares(mass).tolist() == both.score(texts)[1].tolist() == [0.5, 0.0, 0.0, 0.0]


def plain_word_features(text, words, stems):
    """The fifteen word features of a text, each counted on its own, one pair of words at a time."""
    found = toxicity.words_of(text)
    m = len(found)
    if not m:
        return [0.0] * 15
    odd = [not w.isalpha() for w in found]
    plain = ["".join(toxicity._plain.get(ord(c), c) or "" for c in w) for w in found]
    read = [p if o and (p in toxicity.INSULTS or p in words) else w for w, p, o in zip(found, plain, odd, strict=True)]
    known = [words[w] for w in read if w in words]
    hits = [i for i, w in enumerate(read) if w in words or w in toxicity.INSULTS]
    begun = [stems[w[: toxicity.STEM]] for w in found if w[: toxicity.STEM] in stems]
    second = [i for i, w in enumerate(found) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits)
    fixed = sum(w in toxicity.INSULTS for w in read)
    odd_hits = sum(o and (p in toxicity.INSULTS or p in words) for p, o in zip(plain, odd, strict=True))
    return [
        math.log1p(m), len(known), len(known) / m, sum(known) / m, max(known, default=0), fixed, fixed / m, len(begun), len(begun) / m, max(begun, default=0),
        near / m, len(second) / m, sum(odd) / m, odd_hits / m, len({found[i] for i in hits}),
    ]


def test_features_of_words_by_plain_counting():
    words = {"vile": 2.0, "rotten": 1.75, "idiot": 3.0, "grim": 2.25}
    stems = {"rotte": 1.5, "vilen": 2.5}
    pool = "you vile r0tten id10t 1d!ot grim, the a_b stupid du st@pid m0r0n Vileness rottenly your x9 nice day and IDIOT! tu".split()
    draw = random.Random(5)
    texts = [" ".join(draw.choices(pool, k=draw.randrange(0, 60))) for _ in range(200)] + ["", " ", "!!!", "vile", "you", "you a b c vile", "you a b c d vile"]
    got = toxicity.Lexicon(words, stems).features(texts)[:, :15]
    want = np.array([plain_word_features(t, words, stems) for t in texts])
    assert want.any(0).all()  # every feature occurs
    assert np.allclose(got, want, atol=1e-12)
