"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger holds the (blob,
rule, rule version) triples that were ever scanned and the findings they gave. A scan computes the triples of the table
at hand, takes those the ledger has not, reads each of their blobs once, whichever paths hold it, under the rules that it
lacks, and joins all findings, old and new, back to every path of the blob. So a new version of one rule rescans all blobs for that rule alone, and new
documents are scanned for all rules, and nothing else is.

Where there is a ledger, texts pass a bitmap of the hashes of the blobs that lack a rule before they are shuffled: it has
``FILTER_BITS`` bits, however many blobs there are, never stops one that is needed, and lets few others by.

Rules are regular expressions that mean the same to Java and to RE2; matching runs in the JVM. A finding shows the
SHA-256 of the secret and its first four characters, never the secret.

Defined cases. Null text: no blob. Empty text: a blob without findings. Rows that share path and text are one version
(``doc_id`` is part of the path); a null id or source shows as ``null`` in the path. Several equal matches in one blob
are one finding with their count. Extra columns are not read; a table without ``source`` fails with the analyzer's error
for an unknown column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import components

#: Names of secrets in any case, letter by letter: RE2's (?i) also takes letters outside ASCII, Java's does not.
_NAMES = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("token", "secret", "password", "passwd", "api[_-]?key", "access[_-]?key")) + ")"

#: rule -> (version, pattern)
RULES: Mapping[str, tuple[int, str]] = {
    "assigned_token": (2, rf"""{_NAMES}["']? ?[=:] ?(?:["'][0-9A-Za-z_+/=.-]{{16,}}["']|[0-9A-Za-z_+/=.-]{{16,}})"""),
    "aws_access_key": (1, r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    "github_token": (1, r"gh[pousr]_[0-9A-Za-z]{36}"),
    "slack_token": (1, r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    "private_key": (1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    "jwt": (1, r"eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}"),
    "url_credentials": (1, r"[a-z]+://[0-9A-Za-z._-]+:[^@/ ]{4,}@[0-9A-Za-z.-]+"),
}
#: The first version of that rule: names in lower case and quoted values only.
ASSIGNED_TOKEN_1 = (1, r"""(?:token|secret|password|passwd|api_key|access_key) ?[=:] ?["'][0-9A-Za-z_+/=.-]{16,}["']""")
#: Bits of the filter before the shuffle (8 MB); 32,768 of them make a row of it.
FILTER_BITS = 1 << 26
_ROW = 1 << 15
LEDGER = "blob binary, rule string, rule_version int"
FINDINGS = "blob binary, rule string, rule_version int, secret_sha256 string, shown string, occurrences int"


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, path, blob): every row's content address."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat(part("source"), F.lit("/"), part("doc_id")).alias("path"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob")
    )


def _matches(texts: DataFrame, rules: Mapping[str, tuple[int, str]]) -> DataFrame:
    """Findings of each (blob, text, missing) row under the rules whose bit is set in ``missing``."""

    def named(rule: str, version: int):
        return lambda secret: F.struct(F.lit(rule).alias("rule"), F.lit(version).alias("rule_version"), secret.alias("secret"))

    each = [
        F.when(F.col("missing").bitwiseAND(F.lit(1 << i)) != 0, F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), named(rule, version)))
        for i, (rule, (version, pattern)) in enumerate(rules.items())
    ]
    all_ = F.flatten(F.filter(F.array(*each), lambda found: found.isNotNull()))
    # rows equal in id and text are both read and give the same (rule, place) twice
    found = texts.select("blob", F.posexplode(all_).alias("place", "f")).select("blob", "place", "f.*").dropDuplicates(["blob", "place"])
    hashed = found.select("blob", "rule", "rule_version", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), F.substring("secret", 1, 4).alias("shown"))
    return hashed.groupBy("blob", "rule", "rule_version", "secret_sha256", "shown").agg(F.count("*").cast("int").alias("occurrences"))


def lacking(blobs: DataFrame, ledger: DataFrame | None, rules: Mapping[str, tuple[int, str]]) -> DataFrame:
    """The rows of ``blobs`` (blob, ...) that lack a rule, with ``missing``: a bit for each rule at its version."""
    every = (1 << len(rules)) - 1
    if ledger is None:
        return blobs.withColumn("missing", F.lit(every).cast("long"))
    bit = F.lit(0).cast("long")
    for i, (rule, (version, _)) in enumerate(rules.items()):
        bit = F.when((F.col("rule") == rule) & (F.col("rule_version") == version), F.lit(1 << i).cast("long")).otherwise(bit)
    seen = ledger.groupBy("blob").agg(F.bit_or(bit).alias("seen"))
    return blobs.join(seen, "blob", "left").withColumn("missing", F.lit(every).bitwiseXOR(F.coalesce("seen", F.lit(0).cast("long")))).where("missing <> 0").drop("seen")


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: Mapping[str, tuple[int, str]] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings by path, the ledger after this scan, all findings by blob).

    ``ledger`` and ``findings`` are what the last scan returned; None stands for the first.
    """
    if len(rules) > 62:
        raise ValueError("a scan takes at most 62 rules")
    spark = docs.sparkSession
    known = findings if findings is not None else spark.createDataFrame([], FINDINGS)
    at = storage.written(versions(docs), "versions")
    blobs = storage.written(at.groupBy("blob").agg(F.min("doc_id").alias("reader"), F.count("*").alias("paths")), "blobs")
    need = storage.written(lacking(blobs, ledger, rules), "unseen")
    found = storage.written(known.unionByName(_matches(unscanned(docs, need, ledger is not None), rules)), "findings")
    bits = [F.when(F.col("missing").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("rule_version"))) for i, (r, (v, _)) in enumerate(rules.items())]
    new = need.select("blob", F.explode(F.filter(F.array(*bits), lambda b: b.isNotNull())).alias("r")).select("blob", "r.rule", "r.rule_version")
    after = new if ledger is None else ledger.unionByName(new)
    now = F.concat_ws("|", "rule", F.col("rule_version").cast("string")).isin([f"{r}|{v}" for r, (v, _) in rules.items()])
    # findings of a blob are as many as its secrets; its paths may be any number, so they stay where they are
    current = found.where(now).groupBy("blob").agg(F.collect_list(F.struct("rule", "rule_version", "secret_sha256", "shown", "occurrences")).alias("found"))
    held = storage.written(current.join(blobs.select("blob", "paths"), "blob"), "held")
    paths = components.join_skewed(at.distinct(), held, ["blob"], "paths", at.count()).where("found is not null")
    return paths.select("doc_id", "path", F.hex("blob").alias("blob"), F.explode("found").alias("f")).select("doc_id", "path", "blob", "f.*"), after, found


def unscanned(docs: DataFrame, need: DataFrame, filtered: bool) -> DataFrame:
    """(blob, text, missing), each blob of ``need`` read from the row that was chosen for it.

    The rows meet their blobs by (blob, id) in one shuffle; copies under other ids spread over all tasks and end there,
    unscanned. ``filtered``: rows of blobs that lack nothing end before the shuffle.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("ident")
    chosen = need.select("blob", F.coalesce(F.col("reader").cast("string"), F.lit("null")).alias("ident"), "missing")
    texts = docs.where("text is not null").select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").select("blob", ident, "text")
    if filtered:
        texts = _passed(texts, need)
    return texts.join(chosen.hint("merge"), ["blob", "ident"]).select("blob", "text", "missing")


def _passed(texts: DataFrame, need: DataFrame) -> DataFrame:
    """``texts`` whose blob's bit is set among those of ``need``."""
    place = F.pmod(F.xxhash64("blob"), F.lit(FILTER_BITS))
    row, bit = F.floor(place / F.lit(_ROW)).cast("long"), F.pmod(place, F.lit(_ROW))
    bits = need.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = texts.withColumns({"_row": row, "_bit": bit}).join(F.broadcast(bits), "_row")  # at most FILTER_BITS / 8 bytes
    octet = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.where(f"shiftright({octet}, cast(_bit % 8 as int)) % 2 = 1").drop("_row", "_bit", "_bits")


def sql(rules: Mapping[str, tuple[int, str]] = RULES) -> str:
    """DuckDB SQL of the findings by path of a first scan."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, source, text, '{rule}' AS rule, {version} AS rule_version, unnest(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS secret FROM documents" for rule, (version, pattern) in rules.items()
    )
    return f"""SELECT doc_id, coalesce(source, 'null') || '/' || coalesce(doc_id::VARCHAR, 'null') AS path, upper(sha256(text)) AS blob, rule, rule_version::INT AS rule_version,
    sha256(secret) AS secret_sha256, substr(secret, 1, 4) AS shown, count(*)::INT AS occurrences FROM ({each}) GROUP BY ALL"""
