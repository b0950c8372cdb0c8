import random

import numpy as np
import pytest

from heapline.llm import langid


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.train(spark.read.parquet(f"{sf_dir}/lang_samples.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_kneser_ney_is_a_distribution():
    m = langid.fit({"a": ["abab", "abba"], "b": ["xyxy"]}, order=3)
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1),)] + [" "]
    # what the known letters leave over goes to the base, of which each unknown letter gets m.base
    mass = np.exp([m.scores([f"ab{c}"])[0] - m.scores(["ab"])[0] for c in letters])
    assert np.isfinite(m.scores(["日本"])).all() and (mass > 0).all()
    s = m.scores(["ab", "xy"])
    assert s[0, 0] > s[0, 1] and s[1, 1] > s[1, 0]


def test_lookup_equals_plain_search():
    rng = random.Random(1)
    m = langid.fit({"a": ["".join(rng.choice("abcdefgh ") for _ in range(500)).strip()]}, order=4)
    for n, (keys, _, _) in enumerate(m.tables):
        h = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        want = np.array([np.flatnonzero(keys == x)[0] if (keys == x).any() else len(keys) for x in h])
        assert (m._find(n, h) == want).all()


def test_labels():
    good = {"en": "en", "EN": "en", "en-GB": "en", "eng": "en", "English": "en", " de_AT ": "de", "Chinese": "zh", "zh-Hans": "zh"}
    assert {k: langid.label_code(k) for k in good} == good
    assert all(langid.label_code(x) is None for x in (None, "", "xx", "und", "unknown"))


def test_held_out_accuracy(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/lang_samples.parquet").orderBy("sample_id").collect()]
    train, held, test = {}, {}, []
    for i, (lang, text) in enumerate(rows):
        if i % 4 == 3:
            test.append((lang, text))
        else:
            (held if i % 4 == 2 else train).setdefault(lang, []).extend(s for _, _, s in langid.sentences(text))
    m = langid.fit(train)
    langid.calibrate(m, held, langid.LangSpec())
    found = [langid.languages_in(segs) for segs in langid.segments_of(m, [t for _, t in test])]
    right = sum([k for k, _ in f[:1]] == [lang] for f, (lang, _) in zip(found, test))
    assert right >= 0.95 * len(test)


def test_sentences_and_noise(model):
    inside = "The young gardener hides the broke «Onze buurvrouw controleert drie glazen schalen onder de trap.»"
    noisy = "Der Nacht\u200bwächter prü\u00adft die Turm\u200buhr auf dem Markt\u2060platz."
    named = "Der Nachtwächter prüft die Turmuhr auf dem Marktplatz. Xo Velit."
    got = [{k for k, _ in langid.languages_in(s)} for s in langid.segments_of(model, [inside, noisy, named])]
    assert got == [{"en", "nl"}, {"de"}, {"de"}]
    assert all(t[a:b].strip() for t in (inside, noisy) for a, b, _ in langid.sentences(t))


def test_documents(spark, model):
    en, de, zh = "The old watchmaker cleans the water pump behind the mill every evening.", "Der Nachtwächter prüft die Turmuhr auf dem Marktplatz.", "我们的邻居每天晚上在湖边检查两只空桶。"
    rows = [
        (1, en, "en"), (2, en, "EN-us"), (3, en, None), (4, en, "de"), (5, f"{en} {de}", "en"), (6, f"{en} “{de[:-1][4:28]}”", "en"),
        (7, "12 / 48 — 7,5 %", None), (8, "", None), (9, None, "en"), (10, f"{de} {zh}", "zh"), (11, "hahaha" * 40, None), (12, (en + " ") * 3000, "fr"), (4, en, "de"),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, lang string, label string, segment int")
    got = sorted((r.doc_id, r.lang) for r in langid.wrong_labels(df, model).collect())
    assert got == [(3, "en"), (4, "en"), (4, "en"), (5, "de"), (5, "en"), (10, "de"), (10, "zh"), (12, "en")]
    segs = [r for r in langid.segments(df, model).collect() if r.doc_id == 5]
    assert [(s.lang, rows[4][1][s.start_char : s.end_char].strip()) for s in sorted(segs, key=lambda s: s.segment)] == [("en", en), ("de", de)]
    assert langid.documents(df, model).count() == len(rows)
    assert langid.wrong_labels(df.limit(0), model).count() == 0


def test_monotony_is_judged_over_the_whole_sentence():
    words = "the reader opened the window and looked over the quiet harbour before the morning boats came in "
    assert langid._monotonous("ha" * 300) and langid._monotonous("ha" * 105)
    assert not langid._monotonous("ha" * 150 + words.replace(" ", "") * 3)


def test_limits_come_from_held_out_sentences(model):
    assert len(set(model.limits.round(6))) == len(model.langs) and len(set(model.beside.round(6))) == len(model.langs)
    assert (model.limits < model.beside).all()
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(90)).strip() for _ in range(200)]
    got = [langid.languages_in(s) for s in langid.segments_of(model, noise)]
    assert sum(not g for g in got) >= 190


def test_languages_are_those_of_the_samples(spark, sf_dir):
    """Another language needs nothing but samples."""
    who = ["Młody ogrodnik", "Stara nauczycielka", "Nasz sąsiad", "Cicha dziewczynka", "Wysoki piekarz"]
    does = ["chowa złamany klucz", "maluje drewniane krzesło", "czyta długą książkę", "niesie ciężki koszyk", "naprawia zegar na wieży"]
    where = ["pod schodami.", "przed wschodem słońca.", "w małej kuchni."]
    said = [f"{a} {b} {c}" for a in who for b in does for c in where]
    kinds = "sample_id int, lang string, text string"
    more = spark.createDataFrame([(10000 + i, "Polish" if i % 2 else "pl-PL", t) for i, t in enumerate(said[:70])], kinds)
    more = more.unionByName(spark.createDataFrame([(20000 + i, "Volapük", f"binobs flens gudik e golobs ko ob lü zif {w}") for i, w in enumerate(who * 4)], kinds))
    samples = spark.read.parquet(f"{sf_dir}/lang_samples.parquet").select("sample_id", "lang", "text").unionByName(more)
    m = langid.train(samples, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {"pl", "volapük", "en"} <= set(m.langs) and len(m.langs) == 12
    got = [[k for k, _ in langid.languages_in(s)] for s in langid.segments_of(m, [*said[70:], "Golobs ko flens gudik lü zif."])]
    assert got == [["pl"]] * (len(said) - 70) + [["volapük"]]
    docs = spark.createDataFrame([(1, said[71], "polski"), (2, said[72], "pl"), (3, said[73], "VOLAPÜK")], "doc_id int, text string, lang string")
    assert sorted(tuple(r)[:2] for r in langid.wrong_labels(docs, m).collect()) == [(1, "pl"), (3, "pl")]


def test_long_markup_is_no_text():
    tag = '<a class="' + "sehr lange Namen " * 60 + '">'
    assert [s for _, _, s in langid.sentences(tag + "The gardener paints the door.")] == ["the gardener paints the door"]
