import numpy as np
import pytest

from broadsheet.llm import language, toxicity

SYLLABLES = {"aa": ["tion", "the", "er", "and"], "bb": ["ung", "sch", "ein", "ver"], "cc": ["eau", "oui", "tre", "ment"], "dd": ["ción", "ado", "que", "llo"]}


def text(draw, syllables, words=30):
    return " ".join("".join(draw.choice(syllables, draw.integers(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken():
    draw = np.random.default_rng(2)
    return [(i, text(draw, SYLLABLES[lang]), lang) for i in range(400) for lang in [list(SYLLABLES)[i % 4]]]


def test_codewords_are_apart():
    for n in (2, 4, 7, 30):
        code = language.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= (code.shape[1] // 4 if n > 2 else 1)


def test_languages(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    decoder = language.Decoder(language.ngram_counts(docs.where("doc_id % 8 < 4")))
    found = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text"), decoder).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in spoken if i % 8 > 3]) > 0.98
    mixed = language.identify(spark.createDataFrame([(1, spoken[0][1] + " " + spoken[1][1]), (2, None), (3, "12 !"), (None, "")], "doc_id long, text string"), decoder).collect()
    assert [r.lang_pred for r in mixed[1:]] == ["und"] * 3 and mixed[0].score < 0.9
    assert language.identify(docs.limit(0).select("doc_id", "text"), decoder).count() == 0
    assert language.Decoder({}).decode(language.ngrams("abc"))[0] == "und"
    assert language.Decoder({"xx": np.ones(language.FEATURES)}).decode(language.ngrams("abc")) == ("xx", 1.0, False)


def test_toxicity_held_out(spark):
    draw = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        words = text(draw, SYLLABLES[list(SYLLABLES)[i % 4]], 60).split()
        if i % 3 == 0:
            for at in draw.integers(0, 60, 3):
                words[at] = "zogg" + "".join(draw.choice(SYLLABLES["aa"], 1))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 3 == 0)))
    labels += [(0, None), (None, 1), (5000, 1), (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text").where(toxicity.remainder() == 0), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scored]) > 0.95
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"x"}
    edge = toxicity.score_toxicity(spark.createDataFrame([(1, None), (None, ""), (2, "?!")], "doc_id long, text string"), model).collect()
    assert len({r.score for r in edge}) == 1 and 0 <= edge[0].score < 0.5
    assert toxicity.score_toxicity(docs.limit(0).select("doc_id", "text"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, model).collect())


def by_definition(keys_toxic, keys_plain, key):
    """log P(c | four characters, toxic) - log P(c | four characters, plain), from the keys of both classes."""
    from collections import Counter
    from math import log

    counts, seen = (Counter(keys_toxic), Counter(keys_plain)), {*keys_toxic, *keys_plain}
    d, kinds, above = toxicity.DISCOUNT, {}, seen
    for order in (4, 3, 2, 1):
        above = kinds[order] = Counter(k & (1 << 12 * order) - 1 for k in above)
    shared = kinds[1][key & 4095] / sum(kinds[1].values())
    for order in (2, 3, 4):
        g = key & (1 << 12 * order) - 1
        alike = {x: n for x, n in kinds[order].items() if x >> 12 == g >> 12}
        total = sum(alike.values())
        shared = max(kinds[order][g] - d, 0) / total + d * len(alike) / total * shared

    def p(c):
        mine = {k: n for k, n in counts[c].items() if k >> 12 == key >> 12}
        if not mine:
            return shared
        whole = sum(mine.values())
        return max(counts[c][key] - d, 0) / whole + d * len(mine) / whole * shared

    return log(p(0) / p(1))


def test_ratios_equal_their_definition(spark):
    draw = np.random.default_rng(8)
    texts = [(text(draw, SYLLABLES["aa"], 40) + (" zoggtion zogger" if i % 2 else ""), i % 2) for i in range(12)]
    counts = toxicity.ngram_counts(spark.createDataFrame(texts, "text string, toxic int"))
    seen, unseen = toxicity.log_ratios(counts)
    model = toxicity.Ratios(toxicity._hashed(seen, "key", toxicity.SLOT_BITS), toxicity._hashed(unseen, "context", toxicity.CONTEXT_BITS))
    keys = [[int(k) for t, c in texts if c == want for k in toxicity.keys(t) if k] for want in (1, 0)]
    every = sorted({*keys[0], *keys[1]})
    found = model.ratios(np.array(every))
    assert np.allclose(found, [by_definition(*keys, k) for k in every], atol=1e-5)
    assert model.ratios(np.array([0]))[0] == 0
    assert (toxicity.keys("ab cd")[[0, 3]] < 4096).all()  # words start without context


def test_no_ngram_gives_way(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLOT_BITS", 4)
    monkeypatch.setattr(toxicity, "CONTEXT_BITS", 3)
    draw = np.random.default_rng(9)
    texts = [(text(draw, SYLLABLES["bb"], 40) + (" zoggung" if i == 5 else ""), int(i % 4 == 1)) for i in range(12)]
    seen, unseen = toxicity.log_ratios(toxicity.ngram_counts(spark.createDataFrame(texts, "text string, toxic int")))
    model = toxicity.Ratios(toxicity._hashed(seen, "key", toxicity.SLOT_BITS), toxicity._hashed(unseen, "context", toxicity.CONTEXT_BITS))
    keys = [[int(k) for t, c in texts if c == want for k in toxicity.keys(t) if k] for want in (1, 0)]
    every = sorted({*keys[0], *keys[1]})
    assert len(every) > 1 << toxicity.SLOT_BITS
    assert np.allclose(model.ratios(np.array(every)), [by_definition(*keys, k) for k in every], atol=1e-5)
    contexts = {r.context: r.ratio for r in unseen.collect()}
    assert np.allclose(model.ratios(np.array([(c << 12) + 4095 for c in contexts])), list(contexts.values()), atol=1e-6)


def test_keys_that_share_a_slot():
    draw = np.random.default_rng(3)
    key = np.unique(draw.integers(0, 1 << 60, 5000))
    for bits in (1, 20):
        table = toxicity.Table(key[::2], np.arange(len(key[::2]), dtype=np.float32), bits)
        assert (table.find(key[::2]) == np.arange(len(key[::2]))).all() and np.isnan(table.find(key[1::2])).all()
    assert np.isnan(toxicity.Table(key[:0], np.zeros(0, np.float32), 3).find(key)).all()


def test_features_of_many_texts_at_once():
    draw, model = np.random.default_rng(1), toxicity.Ratios(None, None)
    model.ratios = lambda key: np.where(key == 0, 0.0, np.sin(key.astype(float)))
    texts = ["", "?!", "One word", "ΑΣ ΑΣ. İx", " lead and trail ", *(text(draw, SYLLABLES["aa"], n) for n in (1, 3, 200)), "x" * 5000]
    for one, many in zip(texts, model.features(texts * 3), strict=False):
        key = toxicity.keys(one)
        inside = (key & 4095) != 0
        if not inside.any():
            assert not many.any()
            continue
        starts = np.flatnonzero(inside & (key < 4096))
        parts = np.split(np.arange(len(key)), starts)[1:]
        means = sorted((-model.ratios(key)[p].sum() / max(inside[p].sum(), 4) for p in parts))
        expected = [model.ratios(key).sum() / inside.sum(), *(-np.mean(means[:k]) for k in (1, 3, 10))]
        assert np.allclose(many, expected)
    assert (model.features(texts * 3)[: len(texts)] == model.features(texts)).all()


def test_repeated_rows_and_long_texts(spark):
    rows = [(i % 40, ("zogg " if i % 2 else "calm ") + text(np.random.default_rng(i % 40), SYLLABLES["aa"], 20)) for i in range(80)] + [(500, "calm words " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int"))
    found = {}
    for r in toxicity.score_toxicity(docs, model).collect():
        found.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert len(found) == 41 and all(len(s) == 1 for s in found.values()) and found[500, rows[-1][1]].pop() < 0.5
    lang = docs.selectExpr("doc_id", "text", "'aa' lang", "1 score", "2 held_out")
    said = language.identify(lang, language.Decoder(language.ngram_counts(lang))).collect()
    assert len(said) == 81 and {r.lang_pred for r in said} == {"aa"}


def test_decoding_equals_a_plain_version():
    """Margins, losses and shares by the definition, bit by bit."""
    draw = np.random.default_rng(5)
    counts = {x: np.bincount(np.concatenate([language.ngrams(text(draw, s, 50)) for _ in range(5)]), minlength=language.FEATURES) for x, s in SYLLABLES.items()}
    decoder = language.Decoder(counts)
    names = sorted(counts)
    p = {x: [(c + 0.5) / (counts[x].sum() + 0.5 * language.FEATURES) for c in counts[x]] for x in names}
    code = language.codewords(len(names))
    weights = []
    for bit in range(code.shape[1]):
        ones, zeros = ([x for x, row in zip(names, code) if (row[bit] > 0) == side] for side in (True, False))
        weights.append([np.log(np.mean([p[x][f] for x in ones])) - np.log(np.mean([p[x][f] for x in zeros])) for f in range(language.FEATURES)])
    usual = [min(sum(a * b for a, b in zip(p[x], w)) * code[i][bit] for i, x in enumerate(names)) for bit, w in enumerate(weights)]
    scale = [max(u, 1e-3) for u in usual]
    for lang, syllables in SYLLABLES.items():
        features = language.ngrams(text(draw, syllables, 12))
        losses = []
        for row in code:
            z = [language.SHARPNESS * row[bit] * np.mean([w[f] for f in features]) / scale[bit] for bit, w in enumerate(weights)]
            losses.append(sum(np.log1p(np.exp(-x)) * s / sum(scale) for x, s in zip(z, scale)) * len(scale))
        share = np.exp(min(losses) - np.array(losses))
        share /= share.sum()
        said = decoder.decode(features)
        assert said[0] == names[int(share.argmax())] == lang and abs(said[1] - share.max()) < 1e-3


def test_counting_in_parts_changes_nothing(spark, monkeypatch):
    text = "Ein Satz\u00a0mit  Wörtern,\tund\nnoch einer. " * 40
    whole = np.unique(toxicity.keys("\n".join([text, "zwei", text])), return_counts=True)
    monkeypatch.setattr(toxicity, "JOINED", 50)
    parts = list(toxicity._joined([text, "zwei", text]))
    found = np.unique(np.concatenate([toxicity.keys(p) for p in parts]), return_counts=True)
    assert len(parts) > 30 and all((a[whole[0] != 0] == b[found[0] != 0]).all() for a, b in zip(whole, found, strict=True))
