import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import langid, quality, toxicity
from scorelake.llm.common import held_out, labelled_sample

WORDS = {
    "en": "the of and that with which there from this would other about time people water".split(),
    "de": "der die und nicht eine auch werden durch über zwischen können müssen straße größer".split(),
    "es": "que los del para como más pero también porque cuando donde está años después señor".split(),
}


@pytest.fixture(scope="module")
def corpus(make):
    draw, rows = random.Random(3), []
    for k in range(400):
        lang = draw.choice([*WORDS])
        bad, toxic = draw.random() < 0.3, draw.random() < 0.3
        words = draw.choices(WORDS[lang], k=draw.randint(5, 120))
        sentences = [words[i : i + 8] for i in range(0, len(words), 8)]
        if toxic:
            draw.choice(sentences).append(draw.choice(["idiot", "moron", "schlimmling", "schlimmheit"]))
        text = ". ".join(" ".join(s) for s in sentences) + "."
        rows.append((k, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, lang, "a", not bad, toxic))
    return make([r[:4] for r in rows]), rows


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], int(r[4]), int(r[5])) for r in corpus[1] if r[0] % 10], "doc_id bigint, quality int, toxic int")


def folds(spark, modulus, remainder, n=400):
    return {r.id for r in spark.range(n).where(held_out(F.col("id"), modulus, remainder)).collect()}


def test_folds(spark):
    import zlib

    assert folds(spark, 5, 0) == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}


def test_language(spark, corpus):
    docs, rows = corpus
    got = {r.doc_id: r for r in langid.held_out_predictions(docs).collect()}
    tested = folds(spark, 5, 0)
    assert {k for k, r in got.items() if r.held_out} == tested
    assert np.mean([got[k].lang_pred == rows[k][2] for k in tested]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_language_is_learned_without_the_fold(spark, corpus):
    docs, rows = corpus
    tested = [*folds(spark, 5, 0)]
    other = docs.withColumn("lang", F.when(F.col("doc_id").isin(tested), "xx").otherwise(F.col("lang")))
    assert sorted(langid.train(other)) == ["de", "en", "es"]


def test_language_of_odd_rows(odd, none):
    got = {(r.doc_id, r.text): None for r in odd.collect()}
    profiles = langid.train(odd, modulus=1000, remainder=999)
    rows = langid.identify(odd, profiles).collect()
    assert len(rows) == odd.count() and got
    by = {r.doc_id: r for r in rows}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (2, 3, 4, 7))
    assert langid.identify(none, profiles).count() == 0 and langid.train(none) == {}
    assert all(r.lang_pred == "und" for r in langid.identify(odd, {}).collect())


def test_out_of_place_distance_by_hand():
    codes, counts = langid.ngrams("ab ab")
    text = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)).strip("\0")
    assert dict(zip(map(text, codes.tolist()), counts.tolist(), strict=True)) == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    own = langid.profile(codes, counts, 3)
    c = langid.Classifier({"x": own, "y": own[::-1]}, 3)
    assert c("ab ab") == ("x", 1.0)
    c = langid.Classifier({"y": own[::-1]}, 3)
    assert c("ab ab") == ("y", 1 - (2 + 0 + 2) / 9)


def test_quality(spark, corpus, labels):
    docs, rows = corpus
    got = {r.doc_id: r for r in quality.held_out_scores(docs, labels).collect()}
    tested = folds(spark, 5, 0)
    assert len(got) == 400 and {k for k, r in got.items() if r.held_out} == tested
    assert np.mean([bool(got[k].predicted) == rows[k][4] for k in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_rules_in_columns_equal_rules_in_numpy(corpus, labels):
    docs, rows = corpus
    model = quality.train(docs, labels)
    assert model.rules
    x = np.array([quality.statistics(r[1]) for r in rows])
    z = model.base + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[k] for k in range(400)], 1 / (1 + np.exp(-z)))


def test_statistics_read_every_word_of_a_long_text():
    words = [w for k in range(1000) for w in (f"a{k}", "Bb,")] + ["Cc"] * 500
    got = dict(zip(quality.STATISTICS, quality.statistics(" ".join(words)), strict=True))
    assert (got["common_word"], got["capitals"], got["marked"]) == (1000 / 2500, 1500 / 2500, 1000 / 2500)


def test_lasso_is_sparse_and_optimal():
    draw = np.random.default_rng(2)
    z = (draw.random((500, 20)) < 0.4).astype(float)
    y = (draw.random(500) < 1 / (1 + np.exp(-(3 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    w, base = quality.lasso(z, y, 0.02, 3000)
    e = z.T @ (1 / (1 + np.exp(-(z @ w + base))) - y) / 500
    assert (np.abs(e) <= 0.02 + 1e-4).all() and np.allclose(e[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4) and 2 <= (w != 0).sum() < 15


@pytest.mark.parametrize("kind", ["none", "one"])
def test_models_without_two_kinds_of_labels(spark, odd, none, kind):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 1, 1), (7, None, None)] if kind == "one" else [], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.held_out_scores(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.held_out_scores(none, labels).count() == 0


def test_odd_rows(odd, corpus, labels):
    for module in (quality, toxicity):
        rows = module.score(odd, module.train(corpus[0], labels)).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded_and_outside_the_fold(spark, labels):
    s = labelled_sample(labels, "quality", 5, 0, 50).collect()
    assert len(s) == 50 and not {r.doc_id for r in s} & folds(spark, 5, 0)


def test_toxicity(spark, corpus, labels):
    docs, rows = corpus
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    tested = folds(spark, 4, 2)
    assert {k for k, r in got.items() if r.held_out} == tested
    assert np.mean([bool(got[k].predicted) == rows[k][5] for k in tested]) > 0.95


def test_sentences_that_offend(corpus, labels):
    docs, rows = corpus
    model = toxicity.train(docs, labels)
    found = toxicity.offending(docs, model).collect()
    bad = ("idiot", "moron", "schlimm")
    assert np.mean([any(b in r.sentence.lower() for b in bad) for r in found]) > 0.95
    assert {r.doc_id for r in found if rows[r.doc_id][5]} >= {r[0] for r in rows if r[5] and len(r[1]) < 200 and not r[4] is False}
    for r in found[:20]:
        assert toxicity.sentences(rows[r.doc_id][1])[r.nth].strip() == r.sentence


def test_noisy_or_by_hand():
    m = toxicity.Model({"bad": 3.0, "schl-": 2.0}, -1.0)
    p = [1 / (1 + np.exp(-2.0)), 1 / (1 + np.exp(-1.0))]
    assert m.document("A bad one. fine!\nSchlimm") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]), abs=1e-5)
    assert m.sentence("BAD bad") == pytest.approx(p[0]) and m.document(None) == m.document(" \n") == 0


def test_plain_sentences_add_nothing():
    for m in (toxicity.Model({}), toxicity.Model({"bad": 3.0}, -1.0)):
        assert m.located("plain words here. " * 1_000_000) == (0.0, None, None, 0.0) and m.sentence("plain words") == 0
    text = "plain words here. " * 100_000 + "A  Bad One! " + "plain. " * 1000
    p = 1 / (1 + np.exp(-2.0))
    assert m.located(text) == (pytest.approx(p), 100_000, "A  Bad One", pytest.approx(p))


def test_located_sentences_are_those_that_offend(spark, odd, corpus, labels):
    docs, rows = corpus
    model = toxicity.train(docs, labels)
    worst = {}
    for r in toxicity.offending(docs, model, 1e-12).collect():
        if r.doc_id not in worst or r.sentence_score > worst[r.doc_id][2]:
            worst[r.doc_id] = r.nth, r.sentence, r.sentence_score
    for r in toxicity.score(docs, model).collect():
        assert (r.nth, r.sentence, r.sentence_score) == worst.get(r.doc_id, (None, None, 0.0))
    assert toxicity.offending(odd, model).count() == 0
    assert toxicity.offending(odd.selectExpr("doc_id", "concat(text, ' Idiot.') as text"), model).where("sentence like '%Idiot'").count() == odd.where("text is not null").count()


def plain_counts(rows):
    n, pos, words, pos_words = ({} for _ in range(4))
    for text, y in rows:
        bag = {}
        found = set("".join(c if c.isalnum() else " " for c in text.lower()).split())
        for w in found:
            for f in {w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) > k)}:
                bag[f] = bag.get(f, 0) + 1
        bag[""] = len(found)
        for f, c in bag.items():
            for table, v in ((n, 1), (pos, y), (words, c), (pos_words, c * y)):
                table[f] = table.get(f, 0) + v
    return {f: (n[f], pos[f], words[f], pos_words[f]) for f in n}


def test_counts_and_training_against_plain_versions(spark, corpus, labels, monkeypatch):
    docs, rows = corpus
    monkeypatch.setattr(toxicity, "COUNTS", 50)
    texts = toxicity.labelled_texts(docs, labels, "toxic", 4, 2, 1000)
    got = {r.feature: tuple(r)[1:] for r in toxicity.counted(texts).collect()}
    kept = {r.doc_id for r in texts.collect()}
    assert kept == {r[0] for r in rows if r[0] % 10} - folds(spark, 4, 2)
    assert got == plain_counts([(r[1], int(r[5])) for r in rows if r[0] in kept])
    # the loss at the fitted weights is about a minimum: changes of single weights don't lower it by more than a little (of at most 0.7)
    words = toxicity.vocabulary(toxicity.counted(texts))
    known = toxicity._known(texts, words)
    model = toxicity.fit(words, known["sizes"].tolist(), known["places"].tolist(), known["y"].to_numpy())

    def loss(weights, base):
        m = toxicity.Model(weights, base)
        p = np.clip([m.document(rows[i][1]) for i in sorted(kept)], 1e-6, 1 - 1e-9)
        y = np.array([rows[i][5] for i in sorted(kept)])
        return -np.mean(np.where(y, np.log(p), np.log(1 - p))) + 1e-4 / 2 * sum(w * w for w in weights.values())

    least = loss(model.weights, model.base)
    for f in words[:6]:
        for step in (-0.5, 0.5):
            assert loss(model.weights | {f: model.weights[f] + step}, model.base) > least - 5e-4
    assert loss(model.weights, model.base + 0.5) > least - 5e-4 and loss(model.weights, model.base - 0.5) > least - 5e-4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_toxic_documents_of_driver_tables_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.held_out_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    found, toxic, wrong = sum(r.predicted and r.toxic for r in rows), sum(r.toxic for r in rows), sum(r.predicted and not r.toxic for r in rows)
    assert found > 0.8 * toxic and wrong <= 1, (found, toxic, wrong)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_harmless_features_never_add_up(spark):
    """Features that are no more frequent in toxic documents than elsewhere, each alone in 100,000 sentences."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert min(model.weights.values()) >= 0 and toxicity._sigmoid(model.base) < toxicity.SENTENCE_FROM
    counts = toxicity.counted(toxicity.labelled_texts(docs, labels, "toxic", 4, 2, toxicity.SAMPLE)).where("feature not like '%-'").toPandas().set_index("feature")
    total = counts.loc[""]
    harmless = counts[(counts.index != "") & (counts.n >= 4) & (counts.pos * total.n <= counts.n * total.pos)].index
    assert len(harmless) > 200
    strongest = counts.loc[harmless].sort_values("n", ascending=False).index
    plain = [f for f in strongest if not any(f.startswith(w[:-1]) for w in model.weights if w[-1] == "-" and len(f) >= len(w))]
    for f in plain[:25]:
        assert model.document(f"{f} {f}. " * 100_000) == 0
    assert all(model.sentence(f) == 0 for f in plain)


def plain_statistics(text):
    words, lines = text.split(), [x.strip() for x in text.split("\n") if x.strip()]
    raw, w = text.encode(), max(1, len(words))
    size, share = max(1, len(raw)), lambda chars, of: sum(raw.count(c.encode()) for c in chars) / of
    upper, lower = (sum(97 - shift <= b <= 122 - shift for b in raw) for shift in (32, 0))
    ends = [x for x in words if not x[-1].isalnum()]
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    most = max((words.count(x) for x in set(words)), default=0)
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / w, upper / max(1, upper + lower), share("0123456789", size), share("#*$%&|<>", size), share(marks, size), text.count("!") / w, text.count("|") / w,
        text.count(",") / w, text.count(".") / w, sum(b > 127 for b in raw) / size, text.count(" ") / size, text.count("\n") / size, len(set(words)) / w, len(words) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), most / w, sum(x[0].isupper() for x in words) / w, len(ends) / w,
    ]


@pytest.mark.parametrize("n", [0, 1, 7, 200, 401, 3000, 20_000])
def test_statistics_against_a_plain_version(n):
    draw = random.Random(n)
    kinds = ["one", "Two", "dréi,", "4you!", "#tag|", "É", "a&b", "end.\n", "end.\n", "x"]
    text = "".join(draw.choice(kinds) + draw.choice([" ", " ", "  ", "\n"]) for _ in range(n))
    assert np.allclose(quality.statistics(text), plain_statistics(text))
    # what only the end of a long text has counts as well
    if n > 500:
        changed = quality.statistics(text + "Zz! " * (n // 2))
        got = dict(zip(quality.STATISTICS, changed, strict=True))
        assert got["common_word"] > 0.3 and np.allclose(changed, plain_statistics(text + "Zz! " * (n // 2)))


def test_clean_keeps_columns(odd, corpus, labels):
    out = toxicity.clean(odd, labels)
    assert out.columns == odd.columns and out.count() == odd.count()


def plain_paths(x, y, edges, some, depth, least, path=()):
    """The same trees by trying every cut of every feature on the rows themselves."""
    out = [path] if path else []
    if depth == 0 or len(y) < 2 * least or len(set(y)) < 2:
        return out
    best, at = 1e-9, None
    for f in some:
        gains = []
        for cut in edges[f]:
            low = x[:, f] <= cut
            n, p = int(low.sum()), float(y[low].sum())
            ok = n >= least and len(y) - n >= least
            gains.append(p * p / n + (y.sum() - p) ** 2 / (len(y) - n) - y.sum() ** 2 / len(y) if ok else 0.0)
        if gains and max(gains) > best:
            best, at = max(gains), (f, float(edges[f][int(np.argmax(gains))]))
    if at is None:
        return out
    low = x[:, at[0]] <= at[1]
    return out + plain_paths(x[low], y[low], edges, some, depth - 1, least, (*path, (*at, True))) + plain_paths(x[~low], y[~low], edges, some, depth - 1, least, (*path, (*at, False)))


def test_tree_paths_are_those_of_a_plain_search():
    draw = np.random.default_rng(4)
    for size in (30, 200, 600):
        x = draw.integers(0, 12, (size, 4)).astype(float)
        y = ((x[:, 0] > 5) ^ (x[:, 2] > 8) ^ (draw.random(size) < 0.1)).astype(float)
        edges = [np.unique(x[:, f])[:-1] if f != 3 else np.zeros(0) for f in range(4)]
        for some in ([0, 1, 2, 3], [2, 0], [3]):
            got = list(quality._paths(x, y, edges, np.array(some), 3))
            assert got == plain_paths(x, y, edges, some, 3, quality.LEAST) and (got or some == [3] or size == 30)
