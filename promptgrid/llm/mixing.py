"""Mixing sources to target weights, to the token.

Each source's budget is its share of the total, ``floor(total * weight / sum of weights)``, in exact arithmetic. Documents
get a hash-random key and are range-sorted within their source: the key's leading bits give a range (each of about
``RANGE_BYTES`` of what is carried, as hashes are uniform), ranges sort in parallel, their token sums are added up over
the small table of ranges, and a document's prefix sum is its range's plus its own within the range. No task sees a whole
source, so a hot source is cut into as many ranges as its bytes ask for. Sources may be any number: their budgets are
computed and joined in Spark, by broadcast only where they are few.

With S a source's tokens and B its budget, every document is taken floor(B / S) times, once an epoch, and in the last
epoch the documents come whose prefix sum before them is less than B mod S. The last of these uses only the tokens up
to the budget: ``used_tokens`` sums to B exactly, and ``cut`` shortens its text to them.

Tokens here are runs of characters other than white space, counted in one pass, unless ``tokens`` names a column that
holds a count, such as op3's.

Defined cases. Null or empty text: 0 tokens; such documents come once for every whole epoch (at least 1: they cost
nothing and stay). A null count is 0. Null source: a source of its own, of weight ``default_weight``. A source of weight
0, or without tokens, gives only what costs nothing. Documents sort by (key, id, text), nulls first; rows equal in all of
these are interchangeable. Extra columns pass through. A table without ``source`` or ``text`` fails with the analyzer's
error for an unknown column; a negative weight or count is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import components

#: Target weights; sources not named have DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, float] = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
SEED = 17
RANGE_BYTES = 4 << 20
RANGE_BITS = 32
#: Sources up to which their budgets are broadcast, some hundred bytes each.
FEW_SOURCES = 50_000
_WHITE = " \\t\\n\\x0b\\f\\r"


def tokens(text: str = "text") -> Column:
    """Runs of characters other than (ASCII) white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_WHITE}]+")), F.lit(0)).cast("long")


def _integers(weights: Mapping[str, float], default: float) -> tuple[dict[str, int], int]:
    """The weights in whole numbers of the same proportions."""
    exact = {k: Fraction(str(w)) for k, w in [*weights.items(), (None, default)]}
    scale = lcm(*(f.denominator for f in exact.values()))
    whole = {k: int(f * scale) for k, f in exact.items()}
    if any(w >= 10**12 for w in whole.values()):
        raise ValueError("weights must have at most 12 digits over their common denominator")
    return {k: w for k, w in whole.items() if k is not None}, whole[None]


def budgets(slim: DataFrame, source: str, weights: Mapping[str, float], default_weight: float, total: int | None) -> DataFrame:
    """(psource, epochs, rest, ranges, n_rows): a row a source."""
    named, default = _integers(weights, default_weight)
    weight = F.lit(default)
    if named:
        table = F.create_map(*(F.lit(x) for k, w in named.items() for x in (k, w)))
        weight = F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.lit(default)) if "" not in named else F.coalesce(F.try_element_at(table, F.col(source)), F.lit(default))
        weight = F.when(F.col(source).isNull(), default).otherwise(weight)
    sums = slim.groupBy(source).agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n_rows"), F.sum("n_bytes").alias("bytes"))
    sums = storage.written(sums.withColumn("w", weight.cast("decimal(12,0)")), "sources")
    # one row: its size is known
    of = sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("all"), F.sum("w").alias("whole"))))
    want = F.col("all") if total is None else F.lit(total)
    budget = F.when(F.col("whole") > 0, F.expr("cast(want as decimal(20,0)) * w div whole")).otherwise(0)
    of = of.withColumn("want", want.cast("long")).withColumn("budget", budget.cast("long"))
    some = F.col("s") > 0
    return of.select(
        F.col(source).alias("psource"), F.when(some, F.expr("budget div s")).otherwise(0).alias("epochs"), F.when(some, F.expr("budget % s")).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("bytes") / RANGE_BYTES)).cast("long").alias("ranges"), "n_rows",
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    total: int | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    seed: int = SEED,
    carry: list[str] | None = None,
    tokens_column: str | None = None,
) -> DataFrame:
    """(the columns of ``carry``, all by default; epoch, n_tokens, used_tokens): a row for each use of a document.

    ``total``: the tokens wanted in all, by default as many as ``docs`` has. The rows are shuffled once.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    carry = docs.columns if carry is None else carry
    keep = {c: storage.fresh(docs, f"c{i}_") for i, c in enumerate(dict.fromkeys([*carry, "doc_id", "source"]))}
    count = F.coalesce(F.col(f"`{tokens_column}`").cast("long"), F.lit(0)) if tokens_column else tokens()
    if tokens_column:
        count = F.when(count < 0, F.raise_error(F.lit("negative token count"))).otherwise(count)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") if "text" in carry else F.lit(0).cast("long")
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in keep.items()), count.alias("n_tokens"), (size + F.lit(100)).alias("n_bytes"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("key"), F.xxhash64("text").alias("tie"),
    )
    source = keep["source"]
    # where rows carry texts, these are counted once more as they pass rather than written
    heavy = "text" in carry
    slim = storage.written(rows.select(source, "n_tokens", "n_bytes", "key") if heavy else rows, "mix-keys")
    rows = rows if heavy else slim
    plans = storage.written(budgets(slim, source, weights, default_weight, total).withColumns({"part_a": F.coalesce("psource", F.lit("")), "part_b": F.col("psource").isNull()}).drop("psource"), "budgets")
    few = plans.count() <= FEW_SOURCES
    n_rows = slim.count()

    def ranged_of(these: DataFrame) -> DataFrame:
        parted = these.withColumns({"part_a": F.coalesce(source, F.lit("")), "part_b": F.col(source).isNull()})
        if few:
            of = parted.join(F.broadcast(plans.drop("n_rows")), ["part_a", "part_b"])
        else:
            of = components.join_skewed(parted, plans, ["part_a", "part_b"], "n_rows", n_rows)
        lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        return of.withColumn("range", F.floor(lead * F.col("ranges") / F.lit(2**RANGE_BITS)).cast("long"))

    ranged = ranged_of(rows)
    offsets = ranged_of(slim).groupBy("part_a", "part_b", "range").agg(F.sum("n_tokens").alias("range_sum"))
    before = Window.partitionBy("part_a", "part_b").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("part_a", "part_b", "range", F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part_a", "part_b", "range").orderBy("key", keep["doc_id"], "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.sum("n_tokens").over(within)).join(offsets, ["part_a", "part_b", "range"])
    prefix = F.col("offset") + F.col("upto") - F.col("n_tokens")
    last = F.least(F.col("n_tokens"), F.greatest(F.col("rest") - prefix, F.lit(0)))
    free = F.col("n_tokens") == 0
    uses = F.col("epochs") + F.when(free, F.when(F.col("epochs") == 0, 1).otherwise(0)).otherwise((prefix < F.col("rest")).cast("long"))
    taken = summed.withColumns({"last": last, "uses": uses}).where("uses > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    used = F.when(F.col("epoch") < F.col("epochs"), F.col("n_tokens")).otherwise(F.col("last"))
    return taken.select(*(F.col(keep[c]).alias(c) for c in carry), F.col("epoch").cast("int").alias("epoch"), "n_tokens", used.alias("used_tokens"))


def cut(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a mix by its own tokens: a document whose tokens aren't all used is cut after the last used one, and
    ``n_chars`` counts what is left. At most one document a source is."""
    short = F.col("used_tokens") < F.col("n_tokens")
    pieces = F.regexp_extract_all("text", F.lit(f"[{_WHITE}]*[^{_WHITE}]+"), F.lit(0))
    text = F.when(short, F.array_join(F.slice(pieces, F.lit(1), F.col("used_tokens").cast("int")), "")).otherwise(F.col("text"))
    out = mixed.withColumns({"text": text} | ({"n_chars": F.when(short, F.length(text)).otherwise(F.col("n_chars"))} if "n_chars" in columns else {}))
    return out.select(*columns)


def sql(weights: Mapping[str, float] = WEIGHTS, default_weight: float = DEFAULT_WEIGHT, seed: int = SEED) -> str:
    """DuckDB SQL of ``mix`` over documents with the columns (doc_id, source)."""
    named = " ".join(f"WHEN '{s}' THEN {float(w)}" for s, w in weights.items())
    return f"""
    WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
                 md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
    s AS (SELECT source, sum(n_tokens)::BIGINT AS s, CASE source {named} ELSE {float(default_weight)} END AS w FROM d GROUP BY source),
    b AS (SELECT source, s, floor((SELECT sum(s) FROM s) * w / (SELECT sum(w) FROM s))::BIGINT AS budget FROM s),
    p AS (SELECT d.*, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS epochs, CASE WHEN s > 0 THEN budget % s ELSE 0 END AS rest,
                 sum(n_tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS prefix
          FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
    u AS (SELECT *, epochs + CASE WHEN n_tokens = 0 THEN (epochs = 0)::INT ELSE (prefix < rest)::INT END AS uses FROM p),
    e AS (SELECT *, unnest(range(uses)) AS epoch FROM u)
    SELECT doc_id, source, epoch::INT AS epoch, n_tokens, CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, greatest(rest - prefix, 0)) END::BIGINT AS used_tokens FROM e
    """
