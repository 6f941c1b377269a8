import random

import corpus
import numpy as np
import pyarrow as pa
import pytest

from promptgrid.llm import fingerprints


def slow_rolling(data):
    """The rolling hash, a byte at a time."""
    window, out, h1, h2, h3 = [0] * 7, [], 0, 0, 0
    for i, c in enumerate(data):
        h2 = (h2 - h1 + 7 * c) & 0xFFFFFFFF
        h1 = (h1 + c - window[i % 7]) & 0xFFFFFFFF
        window[i % 7] = c
        # a shift register of the last seven bytes
        h3 = 0
        for k in range(min(i + 1, 7)):
            h3 ^= (data[i - k] << (5 * k)) & 0xFFFFFFFF
        out.append((h1 + h2 + h3) & 0xFFFFFFFF)
    return out


def slow_score(a, b, block):
    """Edit distance with substitutions at 2, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
    n = len(a) + len(b)
    return min(100 * (n - row[-1]) // n, block // 3 * min(len(a), len(b)))


def prints(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    return fingerprints.signatures(data, offsets)


def test_rolling_hash():
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 6, 7, 8, 50, 300)]
    offsets = np.cumsum([0, *map(len, rows)])
    got = fingerprints.rolling(np.frombuffer(b"".join(rows), np.uint8), offsets)
    assert got.tolist() == [h for r in rows for h in slow_rolling(r)]


def test_signatures_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [corpus.text(rng, n) for n in (3, 50, 400, 2000)] + ["", "x"]
    together = prints(texts)
    for t, (block, one, two) in zip(texts, together, strict=True):
        ((b, o, w),) = prints([t])
        assert b == block and o.tolist() == one.tolist() and w.tolist() == two.tolist()
        assert len(one) <= 64 and len(two) <= 32


def test_scores_against_the_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a = rng.integers(0, 8, rng.integers(1, 65)).astype(np.uint8)
        many = [rng.integers(0, 8, rng.integers(1, 65)).astype(np.uint8) for _ in range(5)] + [a]
        block = int(rng.choice([3, 6, 96]))
        got = fingerprints.scores(fingerprints._matrix([a] * len(many)), fingerprints._matrix(many), block)
        assert got.tolist() == [slow_score(a.tolist(), m.tolist(), block) for m in many]


def test_local_edits_score_high_and_strangers_nothing():
    rng = random.Random(4)
    a = corpus.text(rng, 900)
    b = a[:2000] + " inserted words " + a[2000:]
    shown = [f"{x}:{fingerprints.ALPHABET[y].tobytes().decode()}:{fingerprints.ALPHABET[z].tobytes().decode()}" for x, y, z in prints([a, b, corpus.text(rng, 900), a + a[:1500]])]
    assert fingerprints.compare(shown[0], shown[0]) == 100
    assert fingerprints.compare(shown[0], shown[1]) >= 85
    assert fingerprints.compare(shown[0], shown[2]) == 0
    assert fingerprints.compare(shown[0], shown[3]) > 50


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    rows = corpus.corpus(seed=8, n=60)
    for i in range(10):
        t = rows[i + 30][1]
        at = rng.randint(0, len(t))
        rows.append(corpus.row(len(rows), t[:at] + " one more remark here " + t[at:] + (t if i % 3 == 0 else "")))
    found = fingerprints.similar(corpus.frame(spark, rows)).collect()
    shown = {r["doc_id"]: f"{r['block_size']}:{r['signature']}:{r['double_signature']}" for r in found}
    ids = sorted(shown)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if fingerprints.compare(shown[a], shown[b]) >= fingerprints.LEAST_SCORE or (shown[a] == shown[b] and len(shown[a].split(":")[1]) >= 7)]
    assert len(pairs) > 10
    assert {r["doc_id"]: r["group_doc_id"] for r in found} == corpus.components(pairs, ids)


def test_near_copies_are_grouped_and_strangers_are_not(spark):
    rng = random.Random(12)
    texts = [corpus.text(rng, 300) for _ in range(60)]
    # two words of each copy are others, far apart; the last 20 texts are short, their copies have another end
    copies = [t[:600] + " another " + t[620:1300] + " word " + t[1310:] for t in texts[:40]]
    short = [t[:150] for t in texts[40:]]
    rows = [corpus.row(i, t) for i, t in enumerate([*texts[:40], *short])] + [corpus.row(100 + i, t) for i, t in enumerate([*copies, *(t[:143] + "changed" for t in short)])]
    group = {r["doc_id"]: r["group_doc_id"] for r in fingerprints.similar(corpus.frame(spark, rows)).collect()}
    assert all(group[i] == i for i in range(60))
    assert sum(group[100 + i] == i for i in range(40)) >= 38
    assert sum(group[140 + i] == 40 + i for i in range(20)) >= 10


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    rows = fingerprints.similar(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["group_doc_id"] is None) == (r["doc_id"] is None)
        if r["doc_id"] in (1, 2, 3, 4, 13):
            assert r["group_doc_id"] == r["doc_id"]
        if r["doc_id"] == 1:
            assert r["block_size"] is None and r["signature"] is None
        if r["doc_id"] == 2:
            assert (r["block_size"], r["signature"]) == (0, "")
        if r["doc_id"] == 8:
            assert r["group_doc_id"] == 7


def test_versions_of_one_id(spark):
    rng = random.Random(21)
    t, u, v = (corpus.text(rng, 300) for _ in range(3))
    remark = u[:500] + " one more remark " + u[500:]
    group = lambda rows: sorted((r["doc_id"], r["group_doc_id"]) for r in fingerprints.similar(corpus.frame(spark, [corpus.row(*r) for r in rows])).collect())
    assert group([(9, t), (9, u), (12, remark), (15, v)]) == [(9, 9), (9, 9), (12, 9), (15, 15)]
    assert group([(3, t), (9, t), (9, u)]) == [(3, 3), (9, 3), (9, 3)]
    assert group([(3, t), (9, t), (9, "short"), (12, u), (12, "x"), (20, "x")]) == [(3, 3), (9, 3), (9, 3), (12, 12), (12, 12), (20, 20)]


def test_index_has_every_gram():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ABCa+/"), int(n))) for n in (0, 3, 7, 12, 40, 64, 64)] + ["A" * 30, "AAAAB" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array([6 * 2 ** (i % 3) for i in range(len(texts))], pa.int64()), pa.array(texts), pa.array([t[:32] for t in texts])], ["node", "block_size", "signature", "double_signature"])
    got = {(r["node"], r["which"], r["key"]) for b in fingerprints._index(iter([batch])) for r in b.to_pylist()}
    code = lambda t: fingerprints._CODE[np.frombuffer(t.encode(), np.uint8)]
    rows = [[fingerprints.squeezed(code(t)).tolist() for t in texts], [fingerprints.squeezed(code(t[:32])).tolist() for t in texts]]
    grams = {(i, k): {(tuple(s[j : j + 7]), 6 * 2 ** (i % 3) << k) for j in range(len(s) - 6)} for k in range(2) for i, s in enumerate(rows[k])}
    keys = {}
    for (i, k), found in grams.items():
        mine = {key for n, w, key in got if (n, w) == (i, k)}
        assert len(mine) == len(found)
        keys[i, k] = (mine, found)
    for one in keys.values():  # keys are shared where grams and block sizes are
        for two in keys.values():
            assert len(one[0] & two[0]) == len(one[1] & two[1])


def test_many_copies(spark):
    text = corpus.text(random.Random(9), 100)
    rows = [corpus.row(i, text) for i in range(3000)] + [corpus.row(5000 + i, corpus.text(random.Random(1000 + i), 60)) for i in range(50)]
    groups = {r["doc_id"]: r["group_doc_id"] for r in fingerprints.similar(corpus.frame(spark, rows)).collect()}
    assert all(groups[i] == 0 for i in range(3000)) and all(groups[5000 + i] == 5000 + i for i in range(50))
