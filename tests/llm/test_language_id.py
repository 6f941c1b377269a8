import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import pytest

from promptgrid.llm import language_id


def slow_ngrams(text):
    out, words = Counter(), "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip():
                    out[gram] += 1
    # neighbouring words share the border between them, so a bigram " x" or "x " is counted with its own word only
    return out


def decode(code):
    return "".join(chr(c) for c in (code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if c)


@pytest.mark.parametrize("text", ["", "123 !", "Été à Paris, it's 5 o'clock", "a", "日本語 text ÄÖÜß", "x  y\n\nz"])
def test_ngrams_against_a_plain_count(text):
    got = Counter(decode(int(c)) for c in language_id.ngrams(text))
    assert got == slow_ngrams(text)
    ranked = [decode(int(c)) for c in language_id.profile(language_id.ngrams(text), 20)]
    assert ranked == [g for g, _ in sorted(got.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]]))][:20]


def test_distance_against_a_plain_count():
    a, b = (language_id.profile(language_id.ngrams(t)) for t in ("the house by the river", "la maison près de la rivière"))
    codes = np.unique(np.concatenate([a, b]))
    ranks = np.full((len(codes), 2), -1, np.int64)
    for k, p in enumerate((a, b)):
        ranks[np.searchsorted(codes, p), k] = np.arange(len(p))
    got = language_id.distances(a, (codes, ranks, ["a", "b"]))
    where = {int(c): i for i, c in enumerate(b)}
    want = sum(abs(i - where[int(c)]) if int(c) in where else language_id.PROFILE for i, c in enumerate(a))
    assert got[0] == 0 and got[1] == pytest.approx(want / (language_id.PROFILE * len(a)))


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    langs = ["en", "fr"]
    train = corpus.frame(spark, [corpus.row(i, corpus.text(rng, 80, langs[i % 2]), langs[i % 2]) for i in range(40)])
    held = corpus.frame(spark, [corpus.row(100 + i, corpus.text(rng, 40, langs[i % 2]), None) for i in range(60)] + [corpus.row(999, "щука жил был дом " * 9)])
    found = {r["doc_id"]: r for r in language_id.identify(held, language_id.train(train)).collect()}
    right = sum(found[100 + i]["language"] == langs[i % 2] and found[100 + i]["accepted"] for i in range(60))
    assert right >= 59
    assert not found[999]["accepted"] and found[999]["distance"] == 1.0
    kept = language_id.keep_accepted(held, language_id.train(train))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["accepted"]}


def test_accuracy_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.identify(docs).join(docs, "doc_id").collect()
    assert sum(r["language"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert all(r["accepted"] for r in found)


@pytest.mark.parametrize("left_out", ["en", "de"])
def test_a_language_left_out_of_training_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = language_id.train(docs.where(f"lang <> '{left_out}'"))
    found = language_id.identify(docs.where(f"lang = '{left_out}'"), profiles).collect()
    assert len(found) > 50 and sum(r["accepted"] for r in found) <= 0.1 * len(found)


def test_training_is_bounded_and_repeatable(spark):
    rng = random.Random(8)
    docs = corpus.frame(spark, [corpus.row(i, corpus.text(rng, 50)) for i in range(30)])
    one, two = language_id.train(docs, sample=5), language_id.train(docs.repartition(7), sample=5)
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]) and one[2] == two[2] == ["en"]


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3, 12, 13) if case != "empty" else ():
        assert tuple(by[i])[1:] == ("und", None, False)
    kept = language_id.keep_accepted(docs)
    assert kept.schema.names == docs.columns
    assert kept.count() == sum(r["accepted"] for r in rows)
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert all(r["language"] == "und" for r in language_id.identify(unlabelled).collect())


def test_training_and_identification_against_brute_force(spark):
    rng = random.Random(10)
    langs = ["en", "fr"]
    rows = [corpus.row(i, corpus.text(rng, rng.randint(3, 120), langs[i % 2]), langs[i % 2]) for i in range(40)] + [corpus.row(90, "щука жил", None), corpus.row(91, "12 3", "en"), corpus.row(92, None, "en")]
    key = lambda x: (-x[1], [ord(c) for c in x[0]])
    profiles = {}
    for lang in langs:
        mine = sorted((hashlib.md5(str(r[0]).encode()).hexdigest(), r[1]) for r in rows if r[2] == lang and r[1] is not None)[:9]
        total = sum((slow_ngrams(t) for _, t in mine), Counter())
        profiles[lang] = {g: k for k, (g, _) in enumerate(sorted(total.items(), key=key)[: language_id.PROFILE])}

    def nearest(text):
        own = [g for g, _ in sorted(slow_ngrams(text or "").items(), key=key)[: language_id.PROFILE]]
        if not own:
            return "und", None, False
        away = {lang: sum(abs(p[g] - k) if g in p else language_id.PROFILE for k, g in enumerate(own)) / (language_id.PROFILE * len(own)) for lang, p in profiles.items()}
        best = min(langs, key=lambda lang: (away[lang], lang))
        return best, pytest.approx(away[best]), away[best] <= language_id.MAX_DISTANCE

    docs = corpus.frame(spark, rows)
    found = {r["doc_id"]: tuple(r)[1:] for r in language_id.identify(docs, language_id.train(docs, sample=9)).collect()}
    assert {i: nearest(t) for i, t, *_ in rows} == found and len({v[0] for v in found.values()}) == 3
