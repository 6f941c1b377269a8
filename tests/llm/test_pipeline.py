import hashlib
import random
import re
from collections import Counter

import corpus
import pytest

import corpus_pipeline
from promptgrid.llm import bpe, language_id, mixing, near_dedup
from test_near_dedup import jaccard, shingles


def test_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokenize"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture
def rows():
    rng = random.Random(11)
    rows = corpus.corpus(seed=11, n=80)
    return [r[:3] + (f"src{r[0] % 4}", r[4]) for r in rows] + [corpus.row(len(rows), "щука жил был дом река " * 20), corpus.row(len(rows) + 1, None), corpus.row(len(rows) + 2, ""), corpus.row(len(rows) + 3, corpus.text(rng, 40), None)]


def plain_mix(rows):
    """(doc_id, text) of the mix by its definition, a source at a time."""
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest(), r[0], r[1]))
    total = sum(len(r[1].split()) for r in rows)
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in sources}
    for s, docs in sources.items():
        budget = int(total * weight[s] / sum(weight.values()))
        own = sum(len(t.split()) for _, _, t in docs)
        while own and budget >= own:
            yield from ((i, t) for _, i, t in docs)
            budget -= own
        for _, i, t in sorted(docs):
            n = len(t.split())
            if budget and n:
                yield i, t if n <= budget else re.match(r"(?:\s*\S+){%d}" % budget, t)[0]
                budget -= min(budget, n)


def test_run_against_brute_force(spark, rows, tmp_path):
    docs = corpus.frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    profiles = language_id.train(docs)

    def accepted(t):
        grams = language_id.profile(language_id.ngrams(t)) if t else ()
        return len(grams) > 0 and language_id.distances(grams, profiles).min() <= language_id.MAX_DISTANCE

    left, texts = [], set()
    for r in sorted((r for r in rows if accepted(r[1])), key=lambda r: r[0]):
        if r[1] not in texts:
            texts.add(r[1])
            left.append(r)
    sets = {r[0]: shingles(r[1]) for r in left}
    ids = sorted(sets)
    pairs = {(a, b): jaccard(sets[a], sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    # documents whose similarity is too near the threshold for an estimate may go either way
    sure = corpus.components([p for p, j in pairs.items() if j >= near_dedup.THRESHOLD + 0.12], ids)
    maybe = corpus.components([p for p, j in pairs.items() if j >= near_dedup.THRESHOLD - 0.12], ids)
    after_near = {r["doc_id"] for r in near_dedup.deduplicate(corpus.frame(spark, left)).collect()}
    assert {i for i in ids if maybe[i] == i} <= after_near <= {i for i in ids if sure[i] == i}
    # the mix and the tokens of what is left, exactly
    final = [r for r in left if r[0] in after_near]
    want = Counter()
    for doc_id, text in plain_mix(final):
        want[(doc_id, tuple(bpe.Codec.of(bpe.VOCABULARY).plain.encode_ordinary(text)), text)] += 1
    assert got == want


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_every_stage_takes_every_frame(spark, case):
    docs = corpus.cases(spark)[case]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
