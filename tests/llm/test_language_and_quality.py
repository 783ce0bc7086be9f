"""Language profiles, the line field and the toxicity grammar: small checks, odd rows, held-out accuracy."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest

from patronlens.llm import language_id, quality_crf, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "\n \n"), (4, "1234 !!"), (5, "日本語のテキスト"), (6, "the " * 30_000), (None, "the and of"), (7, "x"), (7, "x"), (8, "á ß \x00 \x1c")]


def _odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "k") for i, t in ODD], "doc_id long, text string, score double, lang string")


def test_language_of_held_out_documents(spark):
    rows = queries.QUERIES["op1_language_id"](spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_trigram_vectors_are_bound_by_rotation():
    base = language_id.letter_vectors(np.array([97, 98, 99]))
    bound = language_id.gram_vectors(np.array([[97, 98, 99], [99, 98, 97]]))
    assert (bound[0] == np.roll(base[0], 2) * np.roll(base[1], 1) * base[2]).all()
    assert abs((bound[0].astype(int) * bound[1]).sum()) < 200 and set(np.unique(base)) == {-1, 1}


def test_bundle_equals_the_sum_over_letters(monkeypatch):
    texts = ["ab c", None, "", "Éa-éa", "日本 a"]
    full = language_id.bundle(texts, np.arange(5), 5)
    monkeypatch.setattr(language_id, "GRAMS_AT_ONCE", 2)
    assert np.allclose(full, language_id.bundle(texts, np.arange(5), 5))
    grams = [(0, 97, 98), (97, 98, 0), (0, 99, 0)]
    assert np.allclose(full[0], language_id.gram_vectors(np.array(grams)).astype(int).sum(axis=0)) and not full[1].any() and not full[2].any()


def test_odd_texts_and_languages(spark):
    train = spark.createDataFrame([("the cat and dog", "en"), ("der hund und", "de"), (None, "fr"), ("x", None), ("12", "es")], "text string, lang string")
    model = language_id.fit(train)
    assert set(model) == {"en", "de", "es"}
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(_odd(spark), model, ["doc_id", "lang"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (6, "en"), (None, "en")} <= got
    assert {r.lang_pred for r in language_id.predict(_odd(spark), {}, ["doc_id"]).collect()} == {"und"}
    assert language_id.fit(train.limit(0)) == {} and language_id.predict(_odd(spark).limit(0), model, ["doc_id"]).collect() == []


def test_quality_of_held_out_documents(spark):
    rows = queries.QUERIES["op5_quality_crf"](spark, FOLDER).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    counts = np.array([3, 0, 1, 5])
    scores, transition = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    marginals, pairs, log_z = quality_crf.forward_backward(scores, counts, transition)
    begin, seen = 0, np.zeros((2, 2))
    for d, n in enumerate(counts):
        weights = {p: sum(scores[begin + i, y] for i, y in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product((0, 1), repeat=int(n))}
        total = math.log(sum(map(math.exp, weights.values()))) if n else 0.0
        assert log_z[d] == pytest.approx(total)
        for i in range(n):
            assert math.exp(marginals[begin + i, 1]) == pytest.approx(sum(math.exp(w - total) for p, w in weights.items() if p[i]))
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                seen[a, b] += math.exp(w - total)
        begin += n
    assert np.allclose(pairs, seen)


def test_quality_of_odd_texts(spark):
    documents = spark.createDataFrame([(i, "good line here\nand another one" if i % 2 else "X!! Y!! Z!!\nW!! V!!") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (99, 1), (3, None), (4, 7)], "doc_id long, quality int")
    field = quality_crf.fit(documents, labels)
    scored = {(r.doc_id, r.lang): r.score for r in quality_crf.score(_odd(spark), field, ["doc_id", "lang"]).collect()}
    assert scored[(1, "k")] == scored[(2, "k")] == scored[(3, "k")] == 0.0 and all(0 <= s <= 1 for s in scored.values())
    fitted = quality_crf.score_texts(["good line here\nand another one", "X!! Y!! Z!!\nW!! V!!"], field)
    assert fitted[0] > 0.5 > fitted[1]
    nothing = quality_crf.fit(documents, labels.limit(0))
    assert quality_crf.score_texts(["abc", ""], nothing).tolist() == [1.0, 0.0]
    assert quality_crf.score(_odd(spark).limit(0), field, ["doc_id"]).collect() == []


def test_toxicity_of_held_out_documents(spark):
    rows = queries.QUERIES["op6_toxicity"](spark, FOLDER).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and not [r for r in held if r.predicted and not truth[r.doc_id]]
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.6 * sum(truth[r.doc_id] for r in held)


def _clause(model, text):
    classes = toxicity._Classes(model)
    return toxicity.clause_scores([classes[t] for t in toxicity._TOKENS.findall(text.lower())])


def test_grammar_weighs_clauses():
    model = toxicity.Model({"moron": 2.0}, {"idio": 1.0})
    plain, aimed = _clause(model, "a moron"), _clause(model, "you moron")
    assert plain[0] == [2.0] and aimed[0] == [3.0]
    assert _clause(model, "not a moron")[0] == [pytest.approx(0.6)] and _clause(model, "they said: x. he said a moron")[0] == [pytest.approx(2.0 * 0.5 * 1.5)]
    assert _clause(model, "not x. a moron")[0] == [2.0]  # a clause ends at its mark
    assert _clause(model, "i will kill you")[0] == [toxicity.THREAT_WEIGHT] and _clause(model, "i will kill time")[0] == []
    assert _clause(model, "never kill you")[0] == [] and _clause(model, "idiots all")[0] == [1.0] and _clause(model, "idio")[0] == []
    assert _clause(model, "moron moron")[0] == [pytest.approx(2.0 + 2.0 * 1.2)]


def test_composition_is_what_the_parts_do_in_turn():
    one, two = toxicity.negation(), toxicity.target()
    both = toxicity.compose(one, two)
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = b = c = 0
        for symbol in rng.integers(0, 7, 12).tolist():
            a, middle, f = one.arcs[a, symbol]
            b, out, g = two.arcs[b, middle]
            c, whole, h = both.arcs[c, symbol]
            assert (out, f * g) == (whole, pytest.approx(h))


def test_toxicity_of_odd_texts(spark):
    words = ["apple", "pear", "plum"]
    documents = spark.createDataFrame([(i, f"{words[i % 3]} is nice. " + ("you are a blorg blorg. total blorg" if i % 4 == 0 else "it is")) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (999, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    assert "blorg" in model.words and "apple" not in model.words
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "a blorg. you blorg!"), (2, "a pear"), (3, None), (4, "")], "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got[1] > 0.7 > got[2] and got[2] == got[3] == got[4]
    assert all(0 <= r.score <= 1 for r in toxicity.score(_odd(spark), model, ["doc_id", "lang"]).collect())
    assert toxicity.fit(documents, labels.limit(0)).base == 0.0 and toxicity.fit(documents.limit(0), labels).base > 0
    assert toxicity.score(_odd(spark).limit(0), model, ["doc_id"]).collect() == []


def test_a_slice_of_texts_is_scored_in_little_memory():
    quality_crf._kinds()
    width = 3 * quality_crf.FEATURES + 3
    field = quality_crf.Field(np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(quality_crf.FEATURES), np.ones(quality_crf.FEATURES))
    text = "\n".join(f"line {i} of a text with a few words in it" for i in range(40))
    texts = [text] * (quality_crf.BATCH_BYTES // len(text))
    tracemalloc.start()
    try:
        assert len(quality_crf.score_texts(texts, field)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 90 << 20
    finally:
        tracemalloc.stop()
