import random
import re

import corpus
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptgrid.llm import substring_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n\tX", max_size=400))
def test_sentences_make_up_the_text(text):
    parts = sd.sentences(text)
    assert "".join(parts) == (text if text.strip() else "") and all(parts)
    # case doesn't move borders
    assert list(map(len, sd.sentences(text.lower()))) == list(map(len, parts))


CJK = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in sd.UNSPACED)


def slow_sentences(text):
    """By regular expressions and a loop over words."""
    out, begin = [], 0
    words = list(re.finditer(rf"[{CJK}]|[^\s{CJK}]+", text))
    for k, m in enumerate(words):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[0])
        close = words[k + 1].start() if k + 1 < len(words) else len(text)
        if m[0][-1] in sd.ENDS or "\n" in text[m.end() : close] or (ord(low[0]) + len(low)) % sd.CUT == 0 or k + 1 == len(words):
            out.append(text[begin:close])
            begin = close
    return out


def words_of(part):
    return ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(rf"[{CJK}]|[^\s{CJK}]+", part)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abIß .!?\n\t\r\xa0X日本。éÉİ🙂", max_size=300))
def test_sentences_against_regular_expressions(text):
    assert sd.sentences(text) == slow_sentences(text)


def runs(parts):
    """(begin, end) of every span."""
    n = [len(words_of(p)) for p in parts]
    ends = lambda i: next((j for j in range(i + sd.SPAN, len(n) + 1) if sum(n[i:j]) >= sd.MIN_WORDS), None)
    found = {(i, ends(i)) for i in range(len(n)) if ends(i)}
    last = max((i for i in range(len(n) - sd.SPAN + 1) if sum(n[i:]) >= sd.MIN_WORDS), default=None)
    return sorted(found | ({(last, len(n))} if last is not None else set()))


def plain(rows):
    """What is left of each document, by brute force."""
    first, covered, parts = {}, {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        parts[r[0]] = slow_sentences(r[1])
        covered[r[0]] = set()
        for i, j in runs(parts[r[0]]):
            key = tuple(w for p in parts[r[0]][i:j] for w in words_of(p))
            if first.setdefault(key, (r[0], i)) != (r[0], i):
                covered[r[0]] |= set(range(i, j))
    return {r[0]: "".join(p for i, p in enumerate(parts[r[0]]) if i not in covered[r[0]]) if parts[r[0]] else r[1] for r in rows}


@pytest.mark.parametrize("segment", [100, sd.SEGMENT])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(sd, "SEGMENT", segment)
    rng = random.Random(6)
    rows = corpus.corpus(seed=6)
    block = corpus.text(rng, 40)
    rows.append(corpus.row(len(rows), f"{block}\n{corpus.text(rng, 30)}\n{block}"))
    for k in range(12):  # a passage that many share, with other words around it
        rows.append(corpus.row(len(rows), f"{corpus.text(rng, 20)} {block} {corpus.text(rng, 20)} 日本語の文。" + "漢字を使う長い文がここにあるので空白はないですよ。" * (k % 2)))
    want = plain(rows)
    got = {r["doc_id"]: r["text"] for r in sd.cut_documents(corpus.frame(spark, rows)).collect()}
    assert got == {r[0]: want[r[0]] for r in rows if want[r[0]] != r[1]}
    kept = {r["doc_id"]: r["text"] for r in sd.deduplicate(corpus.frame(spark, rows)).collect()}
    assert kept == want


def test_planted_passages_are_caught_and_clean_text_stays(spark):
    rng = random.Random(7)
    rows = []
    for k in range(30):
        # passages of more than 50 words: many sentences, few, or one
        passage = corpus.text(rng, 55) if k % 3 else " ".join(corpus.text(rng, 58).replace(".", ",").split()).rstrip(",") + "."
        for _ in range(3):
            rows.append(corpus.row(len(rows), "\n".join([corpus.text(rng, 70), passage, corpus.text(rng, 70)])))
    rows += [corpus.row(1000 + i, corpus.text(rng, 200)) for i in range(30)]
    found = {r["doc_id"]: r for r in sd.cut_documents(corpus.frame(spark, rows)).collect()}
    for i in range(90):
        if i % 3 == 0:
            assert i not in found
        else:
            # a span may reach a word or two over the passage's end, and two documents may go on alike
            assert i // 3 * 3 in found[i]["first_doc_ids"] and set(found[i]["first_doc_ids"]) <= set(range(i // 3 * 3, i))
            lost = len(rows[i][1].split()) - len(found[i]["text"].split())
            assert 40 <= lost <= 60
    assert all(i < 90 for i in found)


@pytest.mark.parametrize("marks", [".!?", ""])
def test_passages_planted_in_mid_sentence(marks):
    rng = random.Random(9)
    new = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + (rng.choice(marks) if marks and rng.random() < 0.1 else "") for _ in range(n))
    missed = 0
    for _ in range(200):
        passage = new(55)
        one, two = ({h for h, _, _ in sd.spans(f"{new(rng.randint(1, 90))} {passage} {new(90)}")} for _ in range(2))
        missed += not one & two
    assert missed <= 6


@pytest.mark.parametrize("case", ["empty", "edge", "wide"])
def test_frames(spark, case):
    docs = corpus.cases(spark)[case]
    out = sd.deduplicate(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    if case != "empty":
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r["text"])
        assert len(set(by[7])) == 1 and len(by[7]) == 2 and by[7][0]  # equal rows are one document
        assert by[8] == [""]  # a whole copy loses all
        assert by[1] == [None] and by[2] == [""] and by[4] == ["word"]
        assert None in by and len([t for t in by[None] if t]) == 1
    lost = sd.cut_documents(docs).collect()
    assert len([r for r in lost if r["doc_id"] == 8]) == (case != "empty")


def test_sql(spark, tmp_path):
    import duckdb

    from promptgrid.llm import queries

    rng = random.Random(14)
    rows = corpus.corpus(seed=14, n=30)
    block = corpus.text(rng, 40)
    rows += [corpus.row(len(rows) + k, f"  {corpus.text(rng, 20)}\t{block} {corpus.text(rng, 20)} 日本語の文。漢字を使う長い文がここにあるので空白はないですよ。" + " end" * k) for k in range(3)]
    rows += [corpus.row(900, None), corpus.row(901, ""), corpus.row(902, " \n "), corpus.row(903, rows[3][1]), corpus.row(904, f"{block}\n{block}")]
    corpus.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(sd.sql()).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, queries.op10_substring_dedup(spark, str(tmp_path)).select(*names).collect())) == sorted(want) and len(want) > 10


def test_boilerplate_lines_and_tabs(spark):
    rng = random.Random(3)
    line = "this line of thirteen words stands in every one of these documents here.\n"
    rows = [corpus.row(i, corpus.text(rng, 60) + "\n" + line + corpus.text(rng, 60)) for i in range(20)]
    assert sd.cut_documents(corpus.frame(spark, rows)).count() == 0
    # words parted by tabs are words like others
    tabbed = "\t".join(corpus.text(rng, 60).split())
    assert len(sd.sentences(tabbed)) == len(sd.sentences(tabbed.replace("\t", " "))) > 3


def test_many_copies_do_not_fill_one_task(spark):
    """Equal spans are thinned out in each segment, so that one that every document has is no large group."""
    text = corpus.text(random.Random(5), 60)
    docs = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", f"concat('{text}', ' ', md5(string(id)), ' ', md5(string(-id))) AS text")
    spans = docs.withColumn("version", F.xxhash64("text")).mapInArrow(sd._spanner(sd.SPAN, sd.MIN_WORDS), f"{sd._SPANS}, head boolean, more int")
    most = spans.where("head").groupBy("h1", "h2").count().agg(F.max("count")).first()[0]
    assert most <= 8
    found = sd.cut_documents(docs).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 20_000)) and {tuple(r["first_doc_ids"]) for r in found} == {(0,)}
