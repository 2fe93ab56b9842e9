import zlib

import numpy as np

from leafledger.llm import langid
from leafledger.llm.shared import table

WORDS = {"en": "the quick brown fox jumps over the lazy dog and runs away from the house",
         "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg vom haus",
         "fr": "le rapide renard brun saute par-dessus le chien paresseux et quitte la maison"}


def training(make):
    rows, i = [], 0
    for lang, words in WORDS.items():
        parts = words.split()
        for shift in range(12):
            rows.append((i, " ".join((parts[shift % 9:] + parts[: shift % 9]) * 3), lang))
            i += 1
    return rows


def test_held_out_accuracy(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = {r.doc_id: r for r in langid.identify(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    assert {i for i, r in found.items() if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i, r in found.items() if r.held_out]
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_mixture_of_two_languages(make):
    rows = training(make)
    mixed = (WORDS["en"] + ". ") * 6 + (WORDS["de"] + ". ") * 3
    found = langid.identify(make([*rows, (1000, mixed, None), (1001, WORDS["fr"], None)])).collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1001].languages == "fr:1.0000" and by_id[1001].score == 1.0
    shares = dict(p.split(":") for p in by_id[1000].languages.split(","))
    assert set(shares) == {"en", "de"} and by_id[1000].lang_pred == "en" and 0.5 < float(shares["en"]) < 0.85


def test_a_language_label_does_not_decide(make):
    rows = training(make)
    wrong = [(i + 2000, t, "fr") for i, t, _ in rows[:12] if zlib.crc32(str(i + 2000).encode()) % 5 == 0]
    found = {r.doc_id: r.lang_pred for r in langid.identify(make([*rows, *wrong])).collect()}
    assert wrong and all(found[i] == "en" for i, _, _ in wrong)


def test_batches_do_not_matter():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, (langid.BUCKETS, 3)).astype(float)
    model = langid.Model(["a", "b", "c"], counts)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (5, 300, 0, 1, 4000)]
    together = langid.shares(texts, model)
    for text, row in zip(texts, together):
        assert np.allclose(langid.shares([text], model)[0], row)


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    text = langid._prepared("Some words that go on and on. " * 50)
    whole = langid._counts(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    assert (langid._counts(text) == whole).all() and whole.sum() == langid._grams([text])[1].size
    model = langid.Model(["a", "b"], np.stack([whole, whole[::-1]], axis=1).astype(float))
    assert langid.shares([text, b"x"], model)[0].argmax() == 0


def test_odd_rows(make, odd):
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und")} <= rows and (8, "en") in rows
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(odd.where("doc_id = -1")).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3, 9)").count() == 0 and kept.where("doc_id = 5").count() == 2
    unlabelled = make([(1, "text", None)])
    assert [r.lang_pred for r in langid.identify(unlabelled).collect()] == ["und"]
