import hashlib

import corpus
import numpy as np
import pytest

from promptgrid.llm import exact_dedup


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 100, 20_000):
        raw = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n))
        words = exact_dedup._words(raw, n)
        levels = exact_dedup.build_hash(words)
        assert sorted(exact_dedup.slots(words, levels).tolist()) == list(range(n))


def test_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 10)  # several shards
    rows = corpus.corpus(seed=2)
    first = {}
    for r in rows:
        first.setdefault(r[1], r[0])
    want = sorted((r[0], first[r[1]]) for r in rows if first[r[1]] != r[0])
    assert sorted(map(tuple, exact_dedup.duplicates(corpus.frame(spark, rows)).collect())) == want


def test_history_members_go_and_nonmembers_group_on_their_own(spark):
    history = corpus.frame(spark, [corpus.row(1, "old"), corpus.row(2, "older"), corpus.row(0, "old")])
    docs = corpus.frame(spark, [corpus.row(10, "old"), corpus.row(12, "new"), corpus.row(11, "new"), corpus.row(13, "newer"), corpus.row(14, None)])
    gone = sorted(map(tuple, exact_dedup.duplicates(docs, history).collect()))
    assert gone == [(10, 0), (12, 11)]
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs, history).collect()) == [11, 13, 14]
    index, shards = exact_dedup.build_index(history)
    found = {r["doc_id"]: r["member"] for r in exact_dedup.look_up(docs, index, shards).collect()}
    assert found == {10: True, 11: False, 12: False, 13: False}
    assert exact_dedup.deduplicate(docs, corpus.frame(spark, [])).count() == 4


def test_a_false_slot_is_seen_by_its_bytes():
    import pandas as pd

    raw = [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    words = exact_dedup._words(b"".join(raw[:25]), 25)
    levels = exact_dedup.build_hash(words)
    at = exact_dedup.slots(words, levels)
    digests, winners = np.zeros((25, 32), np.uint8), np.zeros(25, np.int64)
    digests[at] = np.frombuffer(b"".join(raw[:25]), np.uint8).reshape(25, 32)
    winners[at] = np.arange(25)
    index = pd.DataFrame([{"shard": 0, "digests": digests.tobytes(), "winners": winners, "levels": [np.packbits(b).tobytes() + len(b).to_bytes(8, "little") for b in levels]}])
    out = exact_dedup._probe(pd.DataFrame({"digest": raw, "least": range(100, 150), "copies": 1, "shard": 0}), index)
    assert out["member"].tolist() == [True] * 25 + [False] * 25
    assert out["winner"].tolist() == [*range(25), *range(125, 150)]


def test_digests_that_agree_in_eight_bytes():
    raw = b"".join(b"same-8-b" + hashlib.sha256(str(i).encode()).digest()[:24] for i in range(40))
    words = exact_dedup._words(raw, 40)
    assert sorted(exact_dedup.slots(words, exact_dedup.build_hash(words)).tolist()) == list(range(40))


def test_a_small_history_is_asked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 5)
    history = corpus.frame(spark, [corpus.row(0, "t3"), corpus.row(1, "t4")])
    docs = corpus.frame(spark, [corpus.row(10 + i, f"t{i % 30}") for i in range(90)])
    gone = {r["doc_id"]: r["winner_doc_id"] for r in exact_dedup.duplicates(docs, history).collect()}
    want = {10 + i: {3: 0, 4: 1}.get(i % 30, 10 + i % 30) for i in range(90)}
    assert gone == {i: w for i, w in want.items() if i != w}


def test_hot_digests(spark, monkeypatch):
    """The rows of a hot text stay where they are; no task gets them all."""
    rows = [corpus.row(i, "hot" if i % 3 else f"t{i}") for i in range(900)]
    gone = {r["doc_id"]: r["winner_doc_id"] for r in exact_dedup.duplicates(corpus.frame(spark, rows)).collect()}
    assert gone == {i: 1 for i in range(2, 900) if i % 3}


def test_query_in_two_rounds(spark, tmp_path):
    from promptgrid.llm import queries

    rows = corpus.corpus(seed=12)
    corpus.frame(spark, [r for r in reversed(rows)]).write.parquet(str(tmp_path / "documents.parquet"))
    first = {}
    for r in rows:
        first.setdefault(r[1], r[0])
    want = sorted((r[0], first[r[1]]) for r in rows if first[r[1]] != r[0])
    assert sorted(map(tuple, queries.op6_exact_dedup(spark, str(tmp_path)).collect())) == want and any(i > 34 for i, _ in want)


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r["text"] for r in docs.collect()]
    assert sorted(r["text"] for r in rows if r["text"] is not None) == sorted({t for t in texts if t is not None})
    assert sum(r["text"] is None for r in rows) == texts.count(None)
    gone = exact_dedup.duplicates(docs).collect()
    assert len(gone) + len(rows) == len(texts)
