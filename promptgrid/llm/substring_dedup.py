"""Substring deduplication over sliding spans of sentences.

A text is a row of words, runs of characters other than white space; a character of a script that is written without
spaces is a word of its own. It is cut into sentences after every word that ends in ``.``, ``!`` or ``?`` (or their wide
forms), at line ends, and after every word whose lower-case first character's code point and length add up to 0 modulo
``CUT``; what lies between two cuts counts as a sentence below. From every sentence on, the shortest run of at least
``SPAN`` sentences with at least ``MIN_WORDS`` words is a span; so is the shortest such run that ends with the text. Spans
are hashed to 128 bits over their lower-cased words, all spans of the corpus meet by hash, and of equal spans the one with
the smallest (doc_id, text version, position) is the first. Every sentence that a non-first span covers is removed.

Each cut depends on the word before it alone, so a passage has the same spans in every document, wherever in a sentence
it begins; what lies before its first cut and after its last stays. A passage is missed if no span lies within it; the
README has the measured share. Boilerplate of fewer than ``MIN_WORDS`` words is left alone.

A span that many documents share, such as a license, is thinned out before it is shuffled: each segment of some hundred
thousand spans sends one of its equal spans on, the head. Only heads meet by hash, so a hot span has a row a segment, and
the others, which can't be the first, are joined with the first spans afterwards, those of hot spans, at most a thousand,
by broadcast.

The result is the documents that lost sentences. Their other sentences stay as they are, with the white space after
them. A copy of a whole document loses all and becomes the empty text (or its leading white space).

Defined cases. Null text or null ``doc_id``: unchanged, never a first. A text that has no span (fewer than SPAN sentences,
or than MIN_WORDS words) is unchanged; so is a word that repeats itself, with no cut or one at every word. Rows equal in
id and text are one document: neither is the other's repeat. Rows that share an id but not the text are two versions,
ordered by a 64-bit hash of their text. Ids are cast to long; a string that is no number fails the job in ANSI mode. Extra
columns pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import arrays, components

SPAN = 2
MIN_WORDS = 22
CUT = 5
#: Spans among which a worker looks for repeats before it sends them on.
SEGMENT = 500_000
ENDS = ".!?。！？｡"
#: Scripts written without spaces: Thai to Burmese, Khmer, kana, ideographs.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))

_U64 = np.uint64
_COLUMNS = ["h1", "h2", "doc_id", "version", "at", "n"]
_SPANS = "h1 long, h2 long, doc_id long, version long, at int, n int"


class Pieces:
    """The words and sentences of the rows of one step.

    ``word``: first code point of every word; ``piece``: first word of every sentence, with the number of words at the
    end; ``first``: first sentence of every row, with the number of sentences at the end; ``row``: first code point of
    every row, with their number at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points, self.row = arrays.code_points(data, offsets)
        n, rows = len(points), len(offsets) - 1
        space, alone = arrays.is_space()[points], _unspaced(points)
        folded = arrays.lower()[points]
        edge = np.zeros(n + 1, bool)
        edge[self.row] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        apart = space[:-1] | space[1:] | alone[:-1] | alone[1:]
        before[1:] = apart | edge[1:-1]
        after[:-1] = before[1:]
        self.word = np.flatnonzero(~space & before)
        last = np.flatnonzero(~space & after)
        lines = np.zeros(n + 1, np.int64)
        np.cumsum(points == 10, out=lines[1:])
        following = np.append(self.word[1:], n)
        ends = np.isin(points[last], _ENDS) | (lines[following] > lines[last]) | ((folded[self.word] + (last - self.word + 1)) % CUT == 0)
        of_row = np.searchsorted(self.word, self.row)
        ends[of_row[1:][of_row[1:] > 0] - 1] = True
        self.piece = np.concatenate([[0], np.flatnonzero(ends) + 1]) if len(self.word) else np.zeros(1, np.int64)
        self.first = np.searchsorted(self.piece, of_row)
        # white space counts for nothing, so a word's sum may run to the next word
        total = np.zeros(n + 1, _U64)
        np.cumsum(np.where(space, _U64(0), (folded.astype(_U64) + _U64(1)) * arrays._power("up", n)), out=total[1:])
        self.hashes = arrays.mix64((total[following] - total[self.word]) * arrays._power("down", n)[self.word]) if n else np.zeros(0, _U64)
        assert rows == len(self.first) - 1

    def spans(self, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first sentence within the row, sentences, (h1, h2)) of every span."""
        n = len(self.piece) - 1
        if n < 1:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros((0, 2), np.int64)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        begin = np.arange(n)
        end = np.maximum(begin + span, np.searchsorted(self.piece, self.piece[:-1] + min_words))
        fits = end <= self.first[row + 1]
        # the run that ends with the text
        rows = np.flatnonzero(np.diff(self.first) >= span)
        close = self.first[rows + 1]
        tail = np.minimum(close - span, np.searchsorted(self.piece, self.piece[close] - min_words, side="right") - 1)
        able = tail >= self.first[rows]
        rows, close, tail = rows[able], close[able], tail[able]
        new = end[tail] != close
        row, begin, end = (np.concatenate(c) for c in ((row[fits], rows[new]), (begin[fits], tail[new]), (end[fits], close[new])))
        halves = np.empty((len(row), 2), np.int64)
        for k in range(2):
            total = np.zeros(len(self.hashes) + 1, _U64)
            mixed = arrays.mix64(self.hashes + _U64(k + 1)) * arrays._power("up", len(self.hashes))
            np.cumsum(mixed, out=total[1:])
            at = self.piece[begin]
            halves[:, k] = arrays.mix64((total[self.piece[end]] - total[at]) * arrays._power("down", len(self.hashes))[at]).view(np.int64)
        return row, begin - self.first[row], end - begin, halves

    def borders(self, row: int) -> np.ndarray:
        """Code points within the row at which its sentences begin, and its length; leading white space is the first's."""
        places = self.word[self.piece[self.first[row] : self.first[row + 1]]] - self.row[row]
        if len(places):
            places[0] = 0
        return np.append(places, self.row[row + 1] - self.row[row])


_ENDS = np.array([ord(c) for c in ENDS], np.uint32)


def _unspaced(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), bool)
    if len(points) and points.max() >= UNSPACED[0][0]:
        for lo, hi in UNSPACED:
            out |= (points >= lo) & (points <= hi)
    return out


def sentences(text: str) -> list[str]:
    """The sentences of a text with the white space after each; together they are the text, if it has a word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at = Pieces(raw, np.array([0, len(raw)])).borders(0).tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def spans(text: str, span: int = SPAN, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(16-byte hash, first sentence, sentences) of each span of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, at, n, halves = Pieces(raw, np.array([0, len(raw)])).spans(span, min_words)
    return [(h.tobytes(), int(a), int(k)) for h, a, k in zip(halves, at, n, strict=True)]


def _thinned(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Spans with ``head``, whether they are the first of their hash here, and ``more``, how many others follow that one."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    same = columns[0][order[1:]] == columns[0][order[:-1]]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    head, more, keep = np.ones(len(order), bool), np.zeros(len(order), np.int32), np.ones(len(order), bool)
    if len(twice):
        twice = twice[np.lexsort([columns[i][twice] for i in (4, 3, 2, 1, 0)])]
        h1, h2, *place = (c[twice] for c in columns[:5])
        again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
        start = np.flatnonzero(~again)
        own = np.repeat(start, np.diff(np.append(start, len(twice))))
        # the same place of a row that is there twice is no other span
        equal = again & (place[0] == place[0][own]) & (place[1] == place[1][own]) & (place[2] == place[2][own])
        head[twice], keep[twice[equal]] = ~again, False
        np.add.at(more, twice[own[again & ~equal]], 1)
    rows = np.flatnonzero(keep)
    return pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in columns), pa.array(head[rows]), pa.array(more[rows])], [*_COLUMNS, "head", "more"])


def _spanner(span: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            data, offsets, _ = arrays.utf8_parts(batch.column(1))
            for lo, hi in arrays.steps(offsets):
                row, at, n, halves = Pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]).spans(span, min_words)
                held.append((halves[:, 0], halves[:, 1], ids[lo:hi][row], versions[lo:hi][row], at.astype(np.int32), n.astype(np.int32)))
                if sum(len(h[0]) for h in held) > SEGMENT:
                    yield _thinned(held)
                    held = []
        if any(len(h[0]) for h in held):
            yield _thinned(held)

    return run


def repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, at, n, first_doc_id): each span of n sentences that isn't the first of its hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("version", F.xxhash64("text"))
    # spans are many times the rows and cheap to make: both users make them, from rows in the same order
    found = _steady(rows).mapInArrow(arrays.tidy(_spanner(span, min_words)), f"{_SPANS}, head boolean, more int")
    place = F.struct("doc_id", "version", "at")
    meet = Window.partitionBy("h1", "h2")
    heads = found.where("head").withColumns({"first": F.min(place).over(meet), "some": F.sum("more").over(meet)})
    heads = heads.withColumn("leads", F.col("first") == place).where("not leads or some > 0")
    heads = storage.written(heads.select(*_COLUMNS, F.col("first.doc_id").alias("first_doc_id"), "leads", "some"), "heads")
    # a row of the first's own that is there twice is as often in the heads
    firsts = storage.written(heads.where("leads").groupBy("h1", "h2").agg(F.min("first_doc_id").alias("first_doc_id"), F.max("some").alias("some")), "firsts")
    followers = firsts.agg(F.coalesce(F.sum("some"), F.lit(0))).first()[0]
    others = components.join_skewed(found.where("not head").select(*_COLUMNS), firsts, ["h1", "h2"], "some", followers)
    out = ["doc_id", "version", "at", "n", "first_doc_id"]
    return heads.where("not leads").select(*out).unionByName(others.select(*out))


def _steady(rows: DataFrame) -> DataFrame:
    """``rows`` in an order that doesn't change when they are computed again: as they are if they come from a scan without
    a shuffle, else written."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return storage.written(rows, "rows") if "Exchange" in plan else rows


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, _ = arrays.utf8_parts(batch.column("text"))
        for lo, hi in arrays.steps(offsets):
            part = batch.slice(lo, hi - lo)
            pieces = Pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            texts, removed, total = [], [], []
            for row, (text, places, lengths) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "places", "lengths")), strict=True)):
                at = pieces.borders(row)
                gone = np.zeros(len(at), np.int64)
                np.add.at(gone, np.array(places), 1)
                np.add.at(gone, np.array(places) + np.array(lengths), -1)
                covered = np.cumsum(gone)[:-1] > 0
                texts.append("".join(text[a:b] for a, b, c in zip(at.tolist(), at[1:].tolist(), covered.tolist(), strict=False) if not c))
                removed.append(int(covered.sum()))
                total.append(len(covered))
            columns = [part.column("doc_id"), part.column("version"), pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(removed, pa.int32()), part.column("first_doc_ids")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "text", "n_sentences", "n_removed", "first_doc_ids"])


def cut_documents(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, first_doc_ids): the documents that lose sentences, what is left of their
    text, and the documents that hold the first spans. Rows equal in id and text give one row."""
    return _cut(docs, span, min_words).drop("version")


def _cut(docs: DataFrame, span: int, min_words: int) -> DataFrame:
    gone = repeated_spans(docs, span, min_words)
    lost = gone.groupBy("doc_id", "version").agg(F.collect_list("at").alias("places"), F.collect_list("n").alias("lengths"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    lost = storage.written(lost, "cuts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("version", F.xxhash64("text"))
    # a row twice over joins twice; the window keeps one and uses the join's partitioning
    joined = rows.join(lost, ["doc_id", "version"])
    one = joined.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "version").orderBy("doc_id"))).where("turn = 1").drop("turn")
    return one.select("doc_id", "version", "text", "places", "lengths", "first_doc_ids").mapInArrow(
        arrays.tidy(_cutter), "doc_id long, version long, text string, n_sentences int, n_removed int, first_doc_ids array<long>"
    )


def deduplicate(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed sentences cut out of ``text``; every row stays."""
    names = {c: storage.fresh(docs, f"cut_{c}") for c in ("doc_id", "version", "text")}
    lost = storage.written(_cut(docs, span, min_words).select(*(F.col(c).alias(n) for c, n in names.items())), "left")
    own = storage.fresh(docs, "version")
    bare = F.col("doc_id").isNull() | F.col("text").isNull()
    rows = docs.where(~bare).withColumn(own, F.xxhash64("text"))
    joined = rows.join(lost, (F.col("doc_id").cast("long") == F.col(names["doc_id"])) & (F.col(own) == F.col(names["version"])), "left")
    cut = joined.withColumn("text", F.when(F.col(names["doc_id"]).isNotNull(), F.col(names["text"])).otherwise(F.col("text")))
    return cut.select(*docs.columns).unionByName(docs.where(bare))


def sql(span: int = SPAN, min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL of ``cut_documents`` over documents whose ids are distinct, the first documents as text."""
    white = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    single = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in UNSPACED)
    return f"""
    WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '(?:[{single}]|[^{white}{single}]+)[{white}]*') AS toks FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    l AS (SELECT *, list_transform(toks, lambda t: lower(regexp_replace(t, '[{white}]+$', ''))) AS words, len(toks) AS n FROM d WHERE len(toks) > 0),
    w AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(toks) AS tok, unnest(words) AS word FROM l),
    e AS (SELECT *, (i = n OR contains('{ENDS}', right(word, 1)) OR contains(tok, chr(10)) OR (unicode(word) + length(word)) % {CUT} = 0)::INT AS closes FROM w),
    g AS (SELECT *, sum(closes) OVER (PARTITION BY doc_id ORDER BY i) - closes AS p FROM e),
    s AS (SELECT doc_id, p, min(i) AS start, string_agg(tok, '' ORDER BY i) AS body FROM g GROUP BY doc_id, p),
    c AS (SELECT doc_id, count(*) AS np, any_value(n) AS n FROM s JOIN l USING (doc_id) GROUP BY doc_id),
    b AS (SELECT doc_id, p, start FROM s UNION ALL SELECT doc_id, np, n + 1 FROM c),
    r AS (SELECT s.doc_id, s.p, greatest(s.p + {span}, b.p) AS q FROM s ASOF JOIN b ON s.doc_id = b.doc_id AND s.start + {min_words} <= b.start),
    t AS (SELECT c.doc_id, least(c.np - {span}, max(s.p)) AS p, c.np AS q FROM c JOIN s ON s.doc_id = c.doc_id AND s.start <= c.n + 1 - {min_words} WHERE c.np >= {span} GROUP BY c.doc_id, c.np),
    u AS (SELECT r.* FROM r JOIN c ON r.doc_id = c.doc_id AND r.q <= c.np UNION SELECT * FROM t),
    k AS (SELECT u.*, list_slice(l.words, x.start, y.start - 1) AS key FROM u JOIN l USING (doc_id) JOIN b x ON x.doc_id = u.doc_id AND x.p = u.p JOIN b y ON y.doc_id = u.doc_id AND y.p = u.q),
    f AS (SELECT *, first_value(doc_id) OVER o AS d1, first_value(p) OVER o AS p1 FROM k WINDOW o AS (PARTITION BY key ORDER BY doc_id, p)),
    x AS (SELECT * FROM f WHERE doc_id <> d1 OR p <> p1),
    h AS (SELECT DISTINCT doc_id, unnest(range(p::BIGINT, q::BIGINT)) AS p FROM x),
    v AS (SELECT doc_id, string_agg(d1::VARCHAR, ',' ORDER BY d1) AS first_doc_ids FROM (SELECT DISTINCT doc_id, d1 FROM x) GROUP BY doc_id)
    SELECT s.doc_id, coalesce(string_agg(CASE WHEN s.p = 0 THEN substr(d.text, 1, length(d.text) - length(array_to_string(d.toks, ''))) ELSE '' END || s.body, '' ORDER BY s.p) FILTER (WHERE h.p IS NULL), '') AS text,
      count(*)::INT AS n_sentences, count(h.p)::INT AS n_removed, any_value(v.first_doc_ids) AS first_doc_ids
    FROM s JOIN v USING (doc_id) JOIN d ON d.doc_id = s.doc_id LEFT JOIN h ON h.doc_id = s.doc_id AND h.p = s.p GROUP BY s.doc_id"""
