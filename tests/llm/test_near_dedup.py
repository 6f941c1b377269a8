import random
import re

import corpus
import numpy as np
import pyarrow as pa
import pytest

from promptgrid.llm import arrays, components, near_dedup


def shingles(text):
    words = re.findall(r"[\u3000-\u9fff\U00010000-\U0010ffff]|[0-9a-z\x80-\u2fff\ua000-\uffff]+", text.lower())
    w = near_dedup.SHINGLE_WORDS
    return {tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_estimates_are_close_to_jaccard():
    rng = random.Random(2)
    worst = []
    for share in (0.0, 0.01, 0.03, 0.06, 0.1, 0.3):
        a = corpus.text(rng, 500)
        b = corpus.edited(rng, a, share)
        raw = [t.encode() for t in (a, b)]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        rows, least = near_dedup.minima(data, offsets)
        packed = near_dedup.pack(least)
        worst.append(abs(float(near_dedup.similarity(packed[0], packed[1:])[0]) - jaccard(shingles(a), shingles(b))))
    assert max(worst) < 0.15 and sum(worst) / len(worst) < 0.06


def test_words_and_shingles_are_those_of_each_row():
    texts = ["One two, three!", "", "four", "One two three", "one  TWO three four", "ab日本cd 漢é🙂"]
    raw = [t.lower().encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    words, first = arrays.word_hashes(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 1, 3, 4, 7]
    found, at = arrays.shingle_hashes(words, first, 3)
    assert np.diff(at).tolist() == [1, 0, 1, 1, 2, 5]
    assert found[at[0]] == found[at[3]] == found[at[4]] != found[at[2]]


def test_groups_against_brute_force(spark):
    rows = corpus.corpus(seed=4, n=120)
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b, jaccard(sets[a], sets[b])) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    true = corpus.components([(a, b) for a, b, j in pairs if j >= near_dedup.THRESHOLD], ids)
    found = {r["doc_id"]: r["kept_doc_id"] for r in near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()}
    label = {i: found.get(i, i) for i in ids}
    wanted = [(a, b) for a, b, j in pairs if j >= near_dedup.THRESHOLD]
    caught = sum(label[a] == label[b] for a, b in wanted)
    assert caught >= 0.9 * len(wanted)
    # what is linked is alike: no clean document goes
    for i, kept in found.items():
        assert true[i] == true[kept] or max(j for a, b, j in pairs if i in (a, b)) > near_dedup.THRESHOLD - 0.15


def test_linking_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 25, int(rng.integers(1, 6)))
        n = int(sizes.sum())
        near = rng.random((n, n))
        near = np.maximum(near, near.T)
        cut = float(rng.choice([0.7, 0.9, 0.97, 0.99]))
        ids = np.sort(rng.choice(max(n, 2) * 2, n, replace=bool(rng.integers(2)) or True))
        run = np.repeat(np.arange(len(sizes)), sizes)
        links = [(int(i), int(j)) for a, b, _ in components.linked_runs(run, ids, lambda i, j, m=near: m[i, j], cut) for i, j in zip(a, b, strict=True)]
        full = [(i, j) for i in range(n) for j in range(i) if run[i] == run[j] and near[i, j] >= cut and ids[i] != ids[j]]
        assert all(near[i, j] >= cut and run[i] == run[j] and ids[i] != ids[j] for i, j in links)
        same = [(i, j) for i in range(n) for j in range(i) if run[i] == run[j] and ids[i] == ids[j]]
        assert corpus.components(links + same, range(n)) == corpus.components(full + same, range(n))


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 100])
def test_shared_keys_in_any_batches(batch):
    rng = random.Random(batch)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 4)) for _ in range(60)) + [(20, 1)] * 5 + [(21, 1), (21, 1), (21, 2), (21, 2)]
    parts = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + batch]], "node": [v for _, v in rows[i : i + batch]]}) for i in range(0, len(rows), batch)]
    got = [tuple(r.values()) for b in components.shared(iter(parts)) for r in b.to_pylist()]
    nodes = {k: {v for x, v in rows if x == k} for k, _ in rows}
    assert got == sorted({r for r in rows if len(nodes[r[0]]) > 1})


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 160)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    if case == "empty":
        assert rows == []
        return
    ids = [r["doc_id"] for r in rows]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(None) == 2
    assert {1, 2, 3, 12, 13} <= set(ids)  # nothing to compare
    assert ids.count(9) == 2  # one id, two texts


def test_many_copies(spark):
    text = corpus.text(random.Random(9), 100)
    docs = corpus.frame(spark, [corpus.row(i, text) for i in range(3000)])
    assert [r["doc_id"] for r in near_dedup.deduplicate(docs).collect()] == [0]


def test_letter_case_beyond_ascii(spark):
    text = "ÉTÉ ÀÈÙ ÑANDÚ ÖL ÄRGER ÜBER " * 5 + "ЖУК ΛΟΓΟΣ ÇA ÎLE"
    docs = corpus.frame(spark, [corpus.row(1, text), corpus.row(2, text.lower()), corpus.row(3, "日本語の長い文章をここに書く" * 3), corpus.row(4, "日本語の長い文章をここに書く" * 3 + "終")])
    assert {r["doc_id"]: r["kept_doc_id"] for r in near_dedup.near_duplicates(docs).collect()} == {2: 1, 4: 3}


def test_copies_are_one_node(spark):
    """However many copies there are, no key has more rows than there are different texts."""
    text = corpus.text(random.Random(3), 80)
    rows = [corpus.row(i, text) for i in range(2000)] + [corpus.row(5000 + i, corpus.text(random.Random(i + 50), 60)) for i in range(20)]
    signed, nodes = near_dedup._signed(corpus.frame(spark, rows))
    assert signed.count() == 2020 and nodes.count() == 21
    found = near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 2000)) and {(r["kept_doc_id"], r["similarity"]) for r in found} == {(0, 1.0)}


def test_ids_of_several_texts(spark):
    t, u = (corpus.text(random.Random(k), 100) for k in (31, 32))
    rows = [corpus.row(9, t), corpus.row(9, u), corpus.row(12, u + " more"), corpus.row(15, t + " other"), corpus.row(20, "alone here")]
    assert {r["doc_id"]: r["kept_doc_id"] for r in near_dedup.near_duplicates(corpus.frame(spark, rows)).collect()} == {12: 9, 15: 9}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicate(corpus.frame(spark, rows)).collect()) == [9, 9, 20]
