"""Small corpora for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "digest string, ident string, turn int, rank int, label string, member boolean, version int, key string, blob string, path string, epoch2 int, node long, c0_ string"
WORDS = {
    "en": "the of and river stone weather through little morning house which where should garden under window".split(),
    "fr": "le la des rivière pierre temps matin maison où jardin sous fenêtre être très avec pour dans".split(),
}


def text(rng, words=120, lang="en"):
    out = []
    while words > 0:
        n = min(words, rng.randint(5, 14))
        out.append(" ".join("".join(rng.choice(WORDS[lang])[: rng.randint(2, 8)] + rng.choice(["", "er", "ing", "al"])) for _ in range(n)).capitalize() + ".")
        words -= n
    return " ".join(out)


def edited(rng, of, share):
    return " ".join("changed" + str(rng.randint(0, 9999)) if rng.random() < share else w for w in of.split(" "))


def row(i, t, lang="en", source="a"):
    return (i, t, lang, source, None if t is None else len(t))


def corpus(seed=1, n=60):
    """Documents with exact copies, near copies of several distances, and a shared passage."""
    rng = random.Random(seed)
    rows, passage = [], text(rng, 60)
    for i in range(n):
        lang = "fr" if i % 4 == 0 else "en"
        rows.append(row(len(rows), text(rng, rng.randint(30, 400), lang), lang, f"s{i % 3}"))
    for i in range(8):
        rows.append(row(len(rows), rows[i][1], rows[i][2], "s0"))
    for i in range(8, 20):
        rows.append(row(len(rows), edited(rng, rows[i][1], 0.02 + 0.02 * (i % 5)), rows[i][2], "s1"))
    for i in range(20, 26):
        rows.append(row(len(rows), text(rng, 80) + "\n" + passage + "\n" + text(rng, 80), "en", "s2"))
    return rows


def edge_rows():
    """Nulls in every column, empty and blank texts, one very long, one long word, ties and repeated rows."""
    rng = random.Random(5)
    long_text = " ".join(text(rng, 200) for _ in range(200))
    same = text(rng, 90)
    return [
        row(1, None), row(2, ""), row(3, "   \n "), row(4, "word"), row(5, "x" * 5000), row(6, long_text), row(7, same), row(7, same), row(8, same),
        (None, same, None, None, None), (None, None, None, None, None), (9, text(rng, 50), None, "a", 1), (10, text(rng, 50), "en", None, 1),
        row(11, "émigré naïve 日本語 🙂 \x00 end."), row(12, "!!! ... ???"), row(13, "."), (9, text(rng, 50), "en", "b", 2),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def cases(spark):
    """Frames that every operator must take: empty, edge rows, and edge rows with clashing extra columns."""
    edge = frame(spark, edge_rows())
    wide = edge
    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        wide = wide.selectExpr("*", f"cast(null as {kind}) as {name}")
    return {"empty": frame(spark, []), "edge": edge, "wide": wide}


def components(pairs, ids):
    """node -> least node of its component."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
