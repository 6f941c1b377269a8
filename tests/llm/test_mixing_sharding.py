import random
from collections import Counter, defaultdict

import corpus
import duckdb
import pytest

from promptgrid.llm import mixing, sharding


def test_budgets_are_met_to_the_token(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_BYTES", 9000)  # several ranges a source
    rows = corpus.corpus(seed=3)
    weights = {"s0": 5.0, "s1": 1.0, "s2": 0.25}
    out = mixing.mix(corpus.frame(spark, rows), weights, total=20_000).collect()
    tokens = {r[0]: len(r[1].split()) for r in rows}
    sums, used, uses = Counter(), Counter(), defaultdict(Counter)
    for r in rows:
        sums[r[3]] += tokens[r[0]]
    for r in out:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        used[r["source"]] += r["used_tokens"]
        uses[r["source"]][r["doc_id"]] += 1
    for s, w in weights.items():
        budget = int(20_000 * w / sum(weights.values()))
        assert used[s] == budget
        assert set(uses[s].values()) <= {budget // sums[s], budget // sums[s] + 1}
    again = mixing.mix(corpus.frame(spark, list(reversed(rows))), weights, total=20_000).collect()
    assert Counter((r["doc_id"], r["epoch"], r["used_tokens"]) for r in out) == Counter((r["doc_id"], r["epoch"], r["used_tokens"]) for r in again)


def test_ranges_give_what_one_sort_gives(spark, monkeypatch):
    rows = corpus.frame(spark, corpus.corpus(seed=6))
    whole = {tuple(r) for r in mixing.mix(rows, total=9_000, carry=["doc_id", "source"]).collect()}
    monkeypatch.setattr(mixing, "RANGE_BYTES", 300)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert {tuple(r) for r in mixing.mix(rows, total=9_000, carry=["doc_id", "source"]).collect()} == whole


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_mix_frames(spark, case):
    docs = corpus.cases(spark)[case]
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "epoch", "n_tokens", "used_tokens"]
    rows = out.collect()
    if case != "empty":
        free = [r for r in rows if r["n_tokens"] == 0]
        assert {r["doc_id"] for r in free} >= {1, 2, 3} and all(r["used_tokens"] == 0 for r in free)
        assert None in {r["source"] for r in rows}
    zero = mixing.mix(docs, {}, default_weight=0.0).collect()
    assert all(r["n_tokens"] == 0 for r in zero)
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(docs, {"a": -1.0})


def test_shares_follow_the_weights(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    tree = {"x": (3.0, {"r": (1.0, sharding._shards(1, 3))}), "y": (1.0, {"r": (1.0, sharding._shards(1)), "q": (1.0, sharding._shards(1))}), "z": (0.0, {})}
    counts = Counter((r["region"], r["rack"], r["shard"]) for r in sharding.assign(ids, tree).collect())
    for path, share in {("x", "r", "s0"): 3 / 16, ("x", "r", "s1"): 9 / 16, ("y", "r", "s0"): 1 / 8, ("y", "q", "s0"): 1 / 8}.items():
        assert abs(counts[path] / 20_000 - share) < 0.015
    assert sum(counts.values()) == 20_000


def test_movement_stays_in_the_subtree_that_changed(spark):
    ids = spark.range(5000).selectExpr("id as doc_id", "'' as text")
    before = {r["doc_id"]: tuple(r)[1:] for r in sharding.assign(ids).collect()}
    tree = dict(sharding.DEFAULT_TREE)
    weight, racks = tree["us"]
    tree["us"] = (weight, racks | {"r1": (4.0, racks["r1"][1])})
    after = {r["doc_id"]: tuple(r)[1:] for r in sharding.assign(ids, tree).collect()}
    moved = [i for i in before if before[i] != after[i]]
    assert moved
    for i in moved:  # to the rack that grew, from others of its region
        assert before[i][0] == after[i][0] == "us" and after[i][1] == "r1" != before[i][1]


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_shard_frames(spark, case):
    docs = corpus.cases(spark)[case]
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count() and all(r["region"] and r["rack"] and r["shard"] for r in rows)
    assert len({tuple(r) for r in rows}) == len({r["doc_id"] for r in rows})
    for bad in ({}, {"a": (0.0, {})}, {"a": (-1.0, {}), "b": (1.0, {})}, {"a/b": (1.0, {})}, {"a": (1.0, {})}, {"a": (1.0, {"b": (1.0, {})})}, {"a": (1.0, {"b": (1.0, {"c": (1.0, {"d": (1.0, {})})})})}):
        with pytest.raises(ValueError, match="weight"):
            sharding.assign(docs, bad)


def test_sql(spark):
    rng = random.Random(1)
    rows = [corpus.row(i, " \n".join([corpus.text(rng, 20), "", corpus.text(rng, 5)]) if i % 7 else "", source=f"src{i % 5}") for i in range(80)]
    docs = corpus.frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for got, sql in ((sharding.assign(docs), sharding.sql()), (mixing.mix(docs, carry=["doc_id", "source"]), mixing.sql())):
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_cut_ends_where_the_budget_does(spark):
    rows = corpus.corpus(seed=9)
    docs = corpus.frame(spark, rows)
    weights = {"s0": 2.0, "s1": 1.0, "s2": 0.5}
    kept = mixing.cut(mixing.mix(docs, weights, total=5_001), docs.columns)
    assert kept.columns == docs.columns
    used, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in kept.collect():
        used[r["source"]] += len(r["text"].split())
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert used == {s: int(5_001 * w / 3.5) for s, w in weights.items()}


def test_counts_may_come_from_a_column(spark):
    rows = corpus.frame(spark, corpus.corpus(seed=9)).selectExpr("*", "n_chars AS bpe")
    used = Counter()
    for r in mixing.mix(rows, {"s0": 3.0}, total=10_000, tokens_column="bpe", carry=["source"]).collect():
        used[r["source"]] += r["used_tokens"]
    assert used == {"s0": 6_000, "s1": 2_000, "s2": 2_000}


def test_weights_are_exact():
    assert mixing._integers({"a": 0.1, "b": 0.2}, 1.0) == ({"a": 1, "b": 2}, 10)
    assert mixing._integers({}, 0.0) == ({}, 0)
