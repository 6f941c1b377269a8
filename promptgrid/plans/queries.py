"""Queries of the pipelines' operators over the test tables, and their DuckDB SQL.

Configuration lists are constants here and VALUES in the SQL; the model is the offline stub, whose replies SQL can
compute. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas, storage
from promptgrid.config import ChatConfig, ClassificationConfig, Expansion, GenericConfig, MCQConfig, PreferenceConfig, RawConfig, Source
from promptgrid.functions import hashing
from promptgrid.functions.hashing import digest_sql, uniform_sql, uuid_sql
from promptgrid.functions.template import compile_template, fill_sql
from promptgrid.functions.text import py_str, strip_fences
from promptgrid.operators import chat, expand, filters, split, stage, views
from promptgrid.operators.preference import swap_by_score
from promptgrid.plans import classification, generic, mcq, preference, raw
from promptgrid.plans import chat as chat_plan
from promptgrid.providers import ScriptedProvider, StubProvider
from promptgrid.plans.run import run
from promptgrid.providers.base import JSON_SUFFIX, WAIT_TARGET, RateLimitError, RequestLimit
from promptgrid.providers.stub import stub_score_sql, stub_sql
from promptgrid.sources import card, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SEED = 42
LANGUAGES = {"en": "English", "fr": "French"}
MODELS = ["stub-a", "stub-b"]
LANGUAGES_SQL = "(VALUES (0, 'en', 'English'), (1, 'fr', 'French')) AS g(language_at, language, language_name)"
MODELS_SQL = "(VALUES (0, 'stub-a'), (1, 'stub-b')) AS p(provider, model_id)"
ITEMS_SQL = "(VALUES (0), (1)) AS i(item)"


def providers() -> list:
    return [StubProvider(m, entries=2) for m in MODELS]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def temporary(spark: SparkSession, kind: str) -> str:
    return f"{storage.shared_dir(spark)}/files/{uuid.uuid4().hex}.{kind}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- expansion ---------------------------------------------------------------------------------------------------

PLACEHOLDERS = {"color": ["amber", "teal", "white"], "animal": ["heron", "otter", "lynx"], "second": ["newt", "wren", "mole"]}
TEMPLATES = ["A {color} {animal} runs.", "The {color} {animal} met a {second}.", "No animals here."]


def _prompt_of(templates: list[str], placeholders: dict[str, list[str]]) -> Column:
    values = {k: F.try_element_at("values", F.lit(k)) for k in placeholders}
    from promptgrid.functions.template import fill

    filled = [fill(compile_template(t, placeholders), values) for t in templates]
    out = F.when(F.col("template") == 0, filled[0])
    for i, f in enumerate(filled[1:], 1):
        out = out.when(F.col("template") == i, f)
    return out


def _values_sql(name: str, values: list[str]) -> str:
    return f"(VALUES {', '.join(f'({i}, {q(v)})' for i, v in enumerate(values))}) AS {name}(i, v)"


@query(
    f"""SELECT (c.i * 3 + a.i)::BIGINT AS expansion, 0 AS template, 'A ' || c.v || ' ' || a.v || ' runs.' AS prompt, c.v AS color, a.v AS animal, NULL::VARCHAR AS second
    FROM {_values_sql("c", PLACEHOLDERS["color"])}, {_values_sql("a", PLACEHOLDERS["animal"])}
    UNION ALL SELECT (9 + c.i * 9 + a.i * 3 + s.i)::BIGINT, 1, 'The ' || c.v || ' ' || a.v || ' met a ' || s.v || '.', c.v, a.v, s.v
    FROM {_values_sql("c", PLACEHOLDERS["color"])}, {_values_sql("a", PLACEHOLDERS["animal"])}, {_values_sql("s", PLACEHOLDERS["second"])}
    UNION ALL SELECT 36::BIGINT, 2, 'No animals here.', NULL, NULL, NULL"""
)
def expand_combinatorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand.expansion_frame(spark, TEMPLATES, Expansion(PLACEHOLDERS), SEED)
    return rows.select("expansion", "template", _prompt_of(TEMPLATES, PLACEHOLDERS).alias("prompt"), *(F.try_element_at("values", F.lit(k)).alias(k) for k in PLACEHOLDERS))


def _random_sql(key: str) -> str:
    values = PLACEHOLDERS[key]
    return f"list_extract([{', '.join(map(q, values))}], floor({uniform_sql(str(SEED), 'n', q(key))} * {len(values)})::INT + 1)"


@query(
    f"""SELECT n AS expansion, (n % 3)::INT AS template, CASE n % 3 WHEN 0 THEN 'A ' || {_random_sql("color")} || ' ' || {_random_sql("animal")} || ' runs.'
    WHEN 1 THEN 'The ' || {_random_sql("color")} || ' ' || {_random_sql("animal")} || ' met a ' || {_random_sql("second")} || '.' ELSE 'No animals here.' END AS prompt
    FROM range(200) AS r(n)"""
)
def expand_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand.expansion_frame(spark, TEMPLATES, Expansion(PLACEHOLDERS, combinatorial=False, num_random_samples=200), SEED)
    return rows.select("expansion", "template", _prompt_of(TEMPLATES, PLACEHOLDERS).alias("prompt"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'Write about {other}.'), (1::BIGINT, 'Plain.')) AS t(expansion, prompt)")
def expand_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = expand.expand_prompts(["Write about {other}.", "Plain."], PLACEHOLDERS)
    return spark.createDataFrame([(i, p) for i, (p, _) in enumerate(found)], "expansion long, prompt string")


@query("SELECT * FROM (VALUES ('{animal} and {color}', 'color,animal'), ('{{second}} stays', 'second'), ('none', '')) AS t(template, used)")
def expand_used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptgrid.functions.template import used_keys

    texts = ["{animal} and {color}", "{{second}} stays", "none"]
    return spark.createDataFrame([(t, ",".join(used_keys(t, PLACEHOLDERS))) for t in texts], "template string, used string")


@query("SELECT * FROM (VALUES ('combinatorial', 37::BIGINT), ('random', 6::BIGINT), ('capped', 1000::BIGINT), ('default', 1::BIGINT), ('empty list', 3::BIGINT)) AS t(mode, expansions)")
def expected_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("combinatorial", expand.num_expansions(TEMPLATES, Expansion(PLACEHOLDERS))),
        ("random", expand.num_expansions(TEMPLATES, Expansion(PLACEHOLDERS, False, 6))),
        ("capped", expand.num_expansions(TEMPLATES, Expansion(PLACEHOLDERS, False, 5000))),
        ("default", expand.num_expansions(None, Expansion(PLACEHOLDERS))),
        ("empty list", expand.num_expansions(["{color} {animal}"], Expansion(PLACEHOLDERS | {"animal": []}))),
    ]
    return spark.createDataFrame(rows, "mode string, expansions long")


# --- text --------------------------------------------------------------------------------------------------------

_FENCED = "CASE doc_id % 5 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '```' || text WHEN 2 THEN '  ' || text || '```  ' WHEN 3 THEN '``` ```' ELSE text END"
_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(
    "SELECT doc_id, length(s)::INT AS n, md5(s) AS digest FROM (SELECT doc_id, "
    + _STRIPPED.format("regexp_replace(regexp_replace(" + _STRIPPED.format(_FENCED) + ", '^`{3}(?:[^\\n]*\\n)?', ''), '`{3}$', '')")
    + " AS s FROM documents)"
)
def strip_fences_(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strip_fences(F.expr(_FENCED.replace("chr(10)", "'\\n'")))
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.length("s").alias("n"), F.md5("s").alias("digest"))


# --- sources and filters -----------------------------------------------------------------------------------------

_DOC_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents"


def _documents_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(_DOC_SQL)
def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_back(readers.load_source(spark, Source(local_file_path=f"{sf_dir}/documents.parquet")))


@query(_DOC_SQL)
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.to_csv(documents(spark, sf_dir), path := temporary(spark, "csv"))
    return _documents_back(readers.load_source(spark, Source(local_file_path=path)))


@query("SELECT text FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS text FROM documents) WHERE text <> ''")
def src_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents(spark, sf_dir).select("text").write.text(path := temporary(spark, "txt"))
    return readers.load_source(spark, Source(local_file_path=path))


@query(_DOC_SQL)
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.to_jsonl(documents(spark, sf_dir), path := temporary(spark, "jsonl"))
    return _documents_back(readers.load_source(spark, Source(local_file_path=path)))


_WINDOWED = "text IS NOT NULL AND length(trim(text)) BETWEEN 100 AND 10000"


@query(f"SELECT doc_id, n_chars FROM documents WHERE {_WINDOWED}")
def filter_doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.length_between(documents(spark, sf_dir), "text", 100, 10_000).select("doc_id", "n_chars")


@query("SELECT d.doc_id, n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(n_chars < 200 OR toxic = 1, false)")
def filter_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.skip(rows, (F.col("n_chars") < 200) | (F.col("toxic") == 1)).select("doc_id", "n_chars")


@query(f"SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src4') ORDER BY {digest_sql('42', 'doc_id')}, doc_id LIMIT 10")
def filter_among(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the rows whose source is one of two, by a seeded draw."""
    return filters.among(documents(spark, sf_dir), "source", ["src1", "src4"], 10, "doc_id", SEED).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def limit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.head(documents(spark, sf_dir), 100, "doc_id").select("doc_id", "lang")


@query("SELECT * FROM (VALUES ('team/corpus'), ('local_file:documents.parquet'), ('unknown_source')) AS t(name)")
def source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [Source(hf_dataset_name="team/corpus", local_file_path="x.csv"), Source(local_file_path=f"{sf_dir}/documents.parquet"), Source()]
    return spark.createDataFrame([(readers.source_name(s),) for s in sources], "name string")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents")
def source_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.numbered(documents(spark, sf_dir).select("doc_id"), "ordinal", "doc_id")


# --- the model stage ---------------------------------------------------------------------------------------------


@query(f"SELECT item_id, 'ok' AS status, {stub_sql('text', q('stub-a'), 'text')} AS reply FROM benchmark")
def llm_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stage.ask(table(spark, sf_dir, "benchmark"), "text", providers(), None, provider=None)
    return asked.select("item_id", "status", "reply")


@query(f"SELECT doc_id, {stub_sql('text', q('stub-a'), 'answer')} AS answer FROM documents")
def llm_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stage.ask(documents(spark, sf_dir).select("doc_id", "text"), "text", providers(), schemas.ANSWER, provider=None, batch=32)
    return stage.answered(asked).select("doc_id", "reply.answer")


class _Echo(StubProvider):
    """Replies with what was sent."""

    def complete(self, conversations, shape):
        import json

        return [json.dumps({"answer": c[-1]["content"]}) for c in conversations]


@query(f"SELECT item_id, text || {q(JSON_SUFFIX)} AS sent FROM benchmark")
def llm_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stage.ask(table(spark, sf_dir, "benchmark"), "text", [_Echo("echo")], schemas.ANSWER, provider=None)
    return asked.select("item_id", F.col("reply.answer").alias("sent"))


_ENTRIES = f"SELECT item_id, item::INT AS item, 'txt-' || md5('stub-a|entries|' || item || '|' || text) AS entry FROM benchmark, {ITEMS_SQL}"


@query(_ENTRIES)
def explode_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = stage.ask(table(spark, sf_dir, "benchmark"), "text", providers(), schemas.TEXT_ENTRIES, provider=None)
    return stage.explode_reply(stage.answered(asked), "reply.entries").select("item_id", "item", "entry")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN doc_id % 6 = 0 THEN 2 END AS n FROM documents")
def parse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are right, trailed by text, of the wrong type, without the key, with half a character and too deep."""
    ready = '{"entries": ["a", "b"], "more": 1}'
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("case "), F.col("doc_id") % 6).alias("prompt"))
    model = ScriptedProvider(canned={"case 0": ready, "case 1": f"{ready} and more", "case 2": '{"entries": [1]}', "case 3": "{}", "case 4": '{"entries": ["\\ud83d", "b"]}', "case 5": "[" * 100_000})
    asked = stage.ask(rows, "prompt", [model], schemas.TEXT_ENTRIES, provider=None)
    return asked.select("doc_id", "status", F.when(F.col("status") == "ok", F.size("reply.entries")).alias("n"))


_TYPED = {
    0: '{"name": "a", "score": 0.5, "ok": true, "count": 5000000000, "tags": ["x", "y"]}',
    1: '{"name": "b", "score": 3, "tags": []}',
    2: '{"name": "c", "score": "2.5", "ok": null, "count": 1, "tags": ["z"]}',
    3: '{"name": "d", "score": 1, "count": 1e30, "tags": []}',
    4: '{"name": "\\ud83d", "score": 1, "tags": []}',
    5: '{"name": "f", "score": "high", "tags": []}',
    6: '{"name": "g", "score": 1, "ok": "perhaps", "tags": []}',
    7: '{"score": 1, "tags": []}',
}


@query(
    """SELECT doc_id, CASE WHEN k < 3 THEN 'ok' ELSE 'failed' END AS status, list_extract(['a', 'b', 'c'], k + 1) AS name, list_extract([0.5, 3.0, 2.5], k + 1)::DOUBLE AS score,
    CASE WHEN k = 0 THEN true END AS ok, CASE k WHEN 0 THEN 5000000000 WHEN 2 THEN 1 END AS count, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS tags FROM (SELECT doc_id, (doc_id % 8)::INT AS k FROM documents)"""
)
def parse_user_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a type given as DDL: fractions, truth values, long integers, absent and null fields; the last five don't
    fit, and fail without ending the job."""
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("case "), F.col("doc_id") % 8).alias("prompt"))
    model = ScriptedProvider(canned={f"case {k}": reply for k, reply in _TYPED.items()})
    kind = "struct<name: string NOT NULL, score: double NOT NULL, ok: boolean, count: bigint, tags: array<string> NOT NULL>"
    asked = stage.ask(rows, "prompt", [model], kind, provider=None)
    return asked.select("doc_id", "status", "reply.name", "reply.score", "reply.ok", "reply.count", F.when(F.col("status") == "ok", F.size("reply.tags")).alias("tags"))


@query("SELECT lang, count(*) FILTER (WHERE source <> 'src3') AS ok, count(*) FILTER (WHERE source = 'src3') AS failed FROM documents GROUP BY lang")
def llm_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", F.concat(F.lit("from "), F.col("source"), F.lit(".")).alias("prompt"))
    asked = stage.ask(rows, "prompt", [ScriptedProvider(failing=("from src3.",))], schemas.ANSWER, provider=None)
    return asked.groupBy("lang").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))


# --- classification and raw text ---------------------------------------------------------------------------------

STYLES = {"style": ["formal", "plain"], "length": ["short", "long", "any"]}
CLASSES = [{"name": "good", "description": "text worth keeping"}, {"name": "poor", "description": "text that isn't"}]
CLASS_PROMPTS = ["{num_samples} {{style}} texts, {{length}}, in {language_name}: {label_name} ({label_description}) of {labels_listing}", "{num_samples} in {language_name} for {label_name}: {label_description}"]
CLASSIFICATION = ClassificationConfig(classes=CLASSES, prompts=CLASS_PROMPTS, num_samples_per_prompt=2, languages=LANGUAGES, expansion=Expansion(STYLES))
_CLASSES_SQL = "(VALUES (0, 'good', 'text worth keeping'), (1, 'poor', 'text that isn''t')) AS c(class_at, label_name, label_description)"
_STYLES_SQL = f"""(SELECT (s.i * 3 + l.i)::BIGINT AS expansion, 0 AS template, s.v AS style, l.v AS length FROM {_values_sql("s", STYLES["style"])}, {_values_sql("l", STYLES["length"])}
    UNION ALL SELECT 6::BIGINT, 1, NULL, NULL) AS e"""


def _variants_sql(variants, values: dict[str, str], placeholders) -> str:
    filled = [fill_sql(p, values | {k: k for k in placeholders}) for p in variants.parts]
    return "CASE template " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(filled)) + " END"


_CLASS_PROMPT = _variants_sql(
    classification.compiled(CLASSIFICATION), {"num_samples": "2", "labels_listing": q("['good', 'poor']")} | {c: c for c in classification.FIELDS[2:]}, STYLES
)
_CLASS_GRID = f"SELECT *, {_CLASS_PROMPT} AS prompt FROM {_CLASSES_SQL}, {LANGUAGES_SQL}, {_STYLES_SQL}, {MODELS_SQL}"


@query(f"SELECT label_name, language, expansion, provider FROM ({_CLASS_GRID})")
def grid_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.grid(spark, CLASSIFICATION, providers()).select("label_name", "language", "expansion", "provider")


@query(f"SELECT DISTINCT prompt FROM ({_CLASS_GRID})")
def prompt_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.grid(spark, CLASSIFICATION, providers()).select("prompt").distinct()


@query(
    f"""SELECT {stub_sql("prompt", "model_id", "entries", "item")} AS text, label_name AS label, model_id, language, 'synthetic' AS label_source,
    {uuid_sql("42", "'classification'", "label_name", "language", "expansion", "provider", "item")} AS uuid FROM ({_CLASS_GRID}), {ITEMS_SQL}"""
)
def classification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification.classification_rows(spark, CLASSIFICATION, providers()).select("text", "label", "model_id", "language", "label_source", "uuid")


RAW = RawConfig(document_types=["letter", "report"], topics=["rivers", "tides", "snow"], prompts=["{num_samples} x {document_type} on {topic} in {language_name}, {{style}} and {{length}}", "{num_samples} {topic} {document_type} {language_name}"], num_samples_per_prompt=2, languages=LANGUAGES, expansion=Expansion(STYLES))
_RAW_PROMPT = _variants_sql(raw.compiled(RAW), {"num_samples": "2"} | {c: c for c in raw.FIELDS[1:]}, STYLES)
_RAW_GRID = f"""SELECT *, {_RAW_PROMPT} AS prompt FROM (VALUES ('letter'), ('report')) AS t(document_type), (VALUES ('rivers'), ('tides'), ('snow')) AS o(topic), {LANGUAGES_SQL}, {_STYLES_SQL}, {MODELS_SQL}"""


@query(f"SELECT document_type, topic, language, expansion, provider FROM ({_RAW_GRID})")
def grid_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.grid(spark, RAW, providers()).select("document_type", "topic", "language", "expansion", "provider")


@query(f"SELECT DISTINCT prompt FROM ({_RAW_GRID})")
def prompt_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.grid(spark, RAW, providers()).select("prompt").distinct()


@query(
    f"""SELECT {stub_sql("prompt", "model_id", "text", "item")} AS text, 'synthetic' AS text_source, model_id, language, document_type, topic,
    {uuid_sql("42", "'raw'", "document_type", "topic", "language", "expansion", "provider", "item")} AS uuid FROM ({_RAW_GRID}), {ITEMS_SQL}"""
)
def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw.raw_rows(spark, RAW, providers())
    return rows.select("text", "text_source", "model_id", "language", F.col("metadata")["document_type"].alias("document_type"), F.col("metadata")["topic"].alias("topic"), "uuid")


# --- multiple choice ---------------------------------------------------------------------------------------------


def _mcq(spark: SparkSession, sf_dir: str) -> MCQConfig:
    return MCQConfig(source=Source(local_file_path=f"{sf_dir}/documents.parquet"), text_column="text", context_column="source", num_samples_per_prompt=2, languages=LANGUAGES)


class _Three(StubProvider):
    """Two questions a document, three wrong answers a question."""

    def _value(self, shape, name, k, prompt):
        if isinstance(shape, list) and shape[0] is str:
            return [self._value(str, name, i, prompt) for i in range(3)]
        return super()._value(shape, name, k, prompt)


_MCQ_VALUES = {"num_samples": "2", "language_name": "language_name", "document": "document", "context": "context"}
_MCQ_PROMPT = f"CASE WHEN context <> '' THEN {fill_sql(compile_template(prompts.MCQ_CONTEXT[0], mcq.FIELDS), _MCQ_VALUES)} ELSE {fill_sql(compile_template(prompts.MCQ[0], mcq.FIELDS), _MCQ_VALUES)} END"
_MCQ_GRID = f"SELECT doc_id AS source_key, language, language_name, provider, model_id, document, {_MCQ_PROMPT} AS prompt FROM (SELECT doc_id, text AS document, source AS context FROM documents WHERE {_WINDOWED}), {LANGUAGES_SQL}, {MODELS_SQL}"


@query(f"SELECT source_key, language, provider, md5(prompt) AS prompt FROM ({_MCQ_GRID})")
def mcq_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.grid(spark, _mcq(spark, sf_dir), providers(), "doc_id").select("source_key", "language", "provider", F.md5("prompt").alias("prompt"))


@query("SELECT doc_id, source <> '' AND lang <> 'fr' AS with_context FROM documents")
def mcq_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("context", F.when(F.col("lang") != "fr", F.col("source")).otherwise(F.lit("")))
    return rows.select("doc_id", filters.has_context(rows, "context").alias("with_context"))


_MCQ_QA = f"SELECT *, {stub_sql('prompt', 'model_id', 'question', 'item')} AS question, {stub_sql('prompt', 'model_id', 'answer', 'item')} AS correct_answer FROM ({_MCQ_GRID}), {ITEMS_SQL}"
_MCQ_WRONG = fill_sql(compile_template(prompts.MCQ_DISTRACTORS, ["question", "correct_answer", "language_name"]), {c: c for c in ("question", "correct_answer", "language_name")})


@query(
    f"""SELECT md5(document) AS source_document, question, correct_answer, {stub_sql("wrong", "model_id", "entries", "0")} AS incorrect_answer_1, {stub_sql("wrong", "model_id", "entries", "1")} AS incorrect_answer_2,
    {stub_sql("wrong", "model_id", "entries", "2")} AS incorrect_answer_3, model_id, 'synthetic' AS mcq_source, language, 'local_file:documents.parquet' AS source_dataset,
    {uuid_sql("42", "'mcq'", "source_key", "language", "0", "provider", "item")} AS uuid FROM (SELECT *, {_MCQ_WRONG} AS wrong FROM ({_MCQ_QA}))"""
)
def mcq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.mcq_rows(spark, _mcq(spark, sf_dir), [_Three(m) for m in MODELS], "doc_id")
    return rows.withColumns({"source_document": F.md5("source_document"), "source_dataset": F.col("metadata")["source_dataset"]}).drop("metadata")


# --- preference pairs --------------------------------------------------------------------------------------------


def _preference(spark: SparkSession, sf_dir: str, judge: bool = True) -> PreferenceConfig:
    return PreferenceConfig(input_documents=documents(spark, sf_dir), num_samples_per_prompt=2, languages=LANGUAGES, llm_as_judge=judge)


@query("SELECT text FROM documents WHERE text IS NOT NULL")
def pref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for preference pairs, through a JSON Lines file."""
    writers.to_jsonl(documents(spark, sf_dir).select("doc_id", "text"), path := temporary(spark, "jsonl"))
    return readers.texts_only(readers.read_jsonl(spark, path))


_PQ_VALUES = {"document": "document", "num_samples": "2", "language_name": "language_name"}
_PQ = "CASE template " + " ".join(f"WHEN {i} THEN {fill_sql(compile_template(t, _PQ_VALUES), _PQ_VALUES)}" for i, t in enumerate(prompts.PREFERENCE_QUESTIONS)) + " END"
_PREF_GRID = f"""SELECT *, {_PQ} AS prompt FROM (SELECT doc_id::VARCHAR AS document_key, text AS document, language, language_name,
    floor({uniform_sql("42", "'template'", "language", "doc_id")} * 3)::INT AS template FROM documents, {LANGUAGES_SQL})"""


@query(f"SELECT document_key, language, template, md5(prompt) AS prompt FROM ({_PREF_GRID})")
def pref_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.questions_grid(spark, _preference(spark, sf_dir), "doc_id").select("document_key", "language", "template", F.md5("prompt").alias("prompt"))


_JUDGE_VALUES = {"document": "text", "question": "lang", "response": "source"}
_JUDGE = fill_sql(compile_template(prompts.PREFERENCE_JUDGE, _JUDGE_VALUES), _JUDGE_VALUES)


@query(f"SELECT doc_id, {stub_score_sql('prompt', q('judge'))} AS score, {stub_sql('prompt', q('judge'), 'assessment')} AS assessment FROM (SELECT doc_id, {_JUDGE} AS prompt FROM documents)")
def pref_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptgrid.functions.template import fill

    values = {k: F.col(v) for k, v in _JUDGE_VALUES.items()}
    rows = documents(spark, sf_dir).select("doc_id", fill(compile_template(prompts.PREFERENCE_JUDGE, values), values).alias("prompt"))
    return stage.ask(rows, "prompt", [StubProvider("judge")], schemas.JUDGEMENT, provider=None).select("doc_id", "reply.score", "reply.assessment")


_SCORES = "(('0x' || substr(md5('a|' || doc_id), 1, 8))::BIGINT % 10 + 1)::INT AS c, CASE WHEN doc_id % 7 > 0 THEN (('0x' || substr(md5('b|' || doc_id), 1, 8))::BIGINT % 10 + 1)::INT END AS r"


@query(
    f"""SELECT doc_id, CASE WHEN coalesce(r > c, false) THEN lang ELSE source END AS chosen_response, CASE WHEN coalesce(r > c, false) THEN source ELSE lang END AS rejected_response,
    CASE WHEN coalesce(r > c, false) THEN r ELSE c END AS chosen_response_score, CASE WHEN coalesce(r > c, false) THEN c ELSE r END AS rejected_response_score FROM (SELECT doc_id, source, lang, {_SCORES} FROM documents)"""
)
def pref_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda tag: (hashing.draw(tag, F.col("doc_id")) % 10 + 1).cast("int")
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("chosen_response"), F.col("lang").alias("rejected_response"), score("a").alias("chosen_response_score"), F.when(F.col("doc_id") % 7 > 0, score("b")).alias("rejected_response_score"))
    return swap_by_score(rows)


def _pref_rows_sql() -> str:
    answer = lambda t: fill_sql(compile_template(t, ["document", "question", "language_name"]), {c: c for c in ("document", "question", "language_name")})
    judge = lambda r: fill_sql(compile_template(prompts.PREFERENCE_JUDGE, ["document", "question", "response"]), {"document": "document", "question": "question", "response": r})
    asked = f"SELECT *, {stub_sql('prompt', q('asker'), 'questions', 'item')} AS question FROM ({_PREF_GRID}), {ITEMS_SQL}"
    answered = f"SELECT *, {stub_sql(answer(prompts.PREFERENCE_CHOSEN), q('strong'), 'answer')} AS c, {stub_sql(answer(prompts.PREFERENCE_REJECTED), q('weak'), 'answer')} AS r FROM ({asked})"
    judged = f"""SELECT *, {stub_score_sql(judge("c"), q("judge"))} AS cs, {stub_score_sql(judge("r"), q("judge"))} AS rs,
        {stub_sql(judge("c"), q("judge"), "assessment")} AS ca, {stub_sql(judge("r"), q("judge"), "assessment")} AS ra FROM ({answered})"""
    side = lambda a, b: f"CASE WHEN rs > cs THEN {b} ELSE {a} END"
    return f"""SELECT md5(document) AS input_document, question, {side("c", "r")} AS chosen_response, {side("r", "c")} AS rejected_response, 'synthetic' AS preference_source,
        {side("'strong'", "'weak'")} AS chosen_model_id, {side("'weak'", "'strong'")} AS rejected_model_id, language, {side("cs", "rs")} AS chosen_response_score, {side("rs", "cs")} AS rejected_response_score,
        {side("ca", "ra")} AS chosen_response_assessment, {side("ra", "ca")} AS rejected_response_assessment, 'asker' AS instruction_model,
        {uuid_sql("42", "'preference'", "document_key", "language", "item")} AS uuid FROM ({judged})"""


@query(_pref_rows_sql())
def pref_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.preference_rows(spark, _preference(spark, sf_dir), StubProvider("asker"), StubProvider("strong"), StubProvider("weak"), StubProvider("judge"), "doc_id")
    return rows.withColumns({"input_document": F.md5("input_document"), "instruction_model": F.col("metadata")["instruction_model"]}).drop("metadata")


# --- chats -------------------------------------------------------------------------------------------------------

TOPICS = {"physics": ["optics", "heat"], "biology": ["cells"]}
PERSONAS = ["a pupil", "an engineer", "a nurse"]
CHAT = ChatConfig(conversation_continuation_prob=0.6, max_turns=3, domain="science", topics_and_subtopics=TOPICS, personas=PERSONAS, num_samples=2, languages=LANGUAGES)
_TOPICS_SQL = "(VALUES ('physics', 'optics'), ('physics', 'heat'), ('biology', 'cells')) AS t(topic, subtopic)"
_CHAT_PROMPT = fill_sql(compile_template(prompts.CHAT_QUESTIONS[0], chat_plan.FIELDS), {"num_samples": "2", "domain": "'science'"} | {c: c for c in ("language_name", "topic", "subtopic")})
_CHAT_GRID = f"SELECT *, 0::BIGINT AS expansion, {_CHAT_PROMPT} AS prompt FROM {_TOPICS_SQL}, {LANGUAGES_SQL}, {MODELS_SQL}"


@query(f"SELECT topic, subtopic, language, provider FROM ({_CHAT_GRID})")
def grid_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_plan.grid(spark, CHAT, providers()).select("topic", "subtopic", "language", "provider")


@query(f"SELECT DISTINCT prompt FROM ({_CHAT_GRID})")
def prompt_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_plan.grid(spark, CHAT, providers()).select("prompt").distinct()


_PERSONA_SQL = "list_extract([" + ", ".join(map(q, PERSONAS)) + "], floor({} * 3)::INT + 1)"


def _turns_sql(most: int, p: float, *key: str) -> str:
    go = [f"{uniform_sql('42', q('turn'), str(t), *key)} < {p}" for t in range(1, most)]
    return "(1" + "".join(f" + ({' AND '.join(go[: k + 1])})::INT" for k in range(len(go))) + ")"


@query(f"SELECT doc_id, {_PERSONA_SQL.format(uniform_sql('42', q('persona'), 'doc_id'))} AS persona FROM documents")
def chat_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", chat.persona(PERSONAS, SEED, F.col("doc_id")).alias("persona"))


@query(f"SELECT doc_id, {_turns_sql(4, 0.5, 'doc_id')}::INT AS turns FROM documents")
def chat_turn_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", chat.turn_count(4, 0.5, SEED, F.col("doc_id")).alias("turns"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS summary FROM conversations GROUP BY conv_id")
def chat_dialog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", F.md5(chat.dialog_summary(F.col("messages"))).alias("summary"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*)::INT AS n FROM conversations GROUP BY conv_id")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), ",")
    return _conversations(spark, sf_dir).select("conv_id", roles.alias("roles"), F.size("messages").alias("n"))


@query("SELECT conv_id, arg_min(text, turn) AS opening_question FROM conversations GROUP BY conv_id")
def chat_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.opening(F.col("messages")).alias("opening_question"))


@query("SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS shown FROM conversations GROUP BY conv_id")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", F.md5(chat.formatted(F.col("messages"))).alias("shown"))


def _chat_rows_sql() -> str:
    key = ("topic", "subtopic", "language", "expansion", "provider", "item")
    first = fill_sql(compile_template(prompts.CHAT_REFORMULATE, ["question", "persona", "topic", "subtopic"]), {c: c for c in ("question", "persona", "topic", "subtopic")})
    answer = fill_sql(compile_template(prompts.CHAT_ANSWER, ["domain", "topic", "subtopic", "question"]), {"domain": "'science'", "topic": "topic", "subtopic": "subtopic", "question": "q1"})
    follow = lambda d: fill_sql(compile_template(prompts.CHAT_FOLLOW_UP, ["dialog_summary", "persona", "subtopic", "domain"]), {"dialog_summary": d, "persona": "persona", "subtopic": "subtopic", "domain": "'science'"})
    s1 = f"SELECT *, {stub_sql('prompt', 'model_id', 'questions', 'item')} AS question, {_PERSONA_SQL.format(uniform_sql('42', q('persona'), *key))} AS persona, {_turns_sql(3, 0.6, *key)} AS turns FROM ({_CHAT_GRID}), {ITEMS_SQL}"
    s2 = f"SELECT *, {stub_sql(first, 'model_id', 'question')} AS q1 FROM ({s1})"
    s3 = f"SELECT *, {stub_sql(answer, 'model_id', 'answer')} AS a1 FROM ({s2})"
    s4 = f"SELECT *, q1 || chr(10) || a1 AS d1 FROM ({s3})"
    s5 = f"SELECT *, CASE WHEN turns > 1 THEN {stub_sql(follow('d1'), 'model_id', 'question')} END AS q2 FROM ({s4})"
    s6 = f"SELECT *, {stub_sql('q2', 'model_id', 'answer')} AS a2 FROM ({s5})"
    s7 = f"SELECT *, d1 || chr(10) || q2 || chr(10) || a2 AS d2 FROM ({s6})"
    s8 = f"SELECT *, CASE WHEN turns > 2 THEN {stub_sql(follow('d2'), 'model_id', 'question')} END AS q3 FROM ({s7})"
    s9 = f"SELECT *, {stub_sql('q3', 'model_id', 'answer')} AS a3 FROM ({s8})"
    return f"""SELECT q1 AS opening_question, concat_ws(chr(10), q1, a1, q2, a2, q3, a3) AS dialog, (2 * turns)::INT AS n_messages, model_id, language, persona, topic, subtopic,
        {uuid_sql("42", "'chat'", *key)} AS uuid FROM ({s9})"""


@query(_chat_rows_sql())
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_plan.chat_rows(spark, CHAT, providers())
    return rows.select(
        "opening_question", chat.dialog_summary(F.col("messages")).alias("dialog"), F.size("messages").alias("n_messages"), "model_id", "language", "persona", F.col("metadata")["topic"].alias("topic"), F.col("metadata")["subtopic"].alias("subtopic"), "uuid"
    )


# --- the generic pipeline ----------------------------------------------------------------------------------------

GENERIC_PROMPTS = ["{num_samples} keywords in {language}, {{style}}: {text} ({lang})", "Sum up in {language} ({num_samples}): {lang} {text}"]


def generic_config(spark: SparkSession, sf_dir: str) -> GenericConfig:
    return GenericConfig(
        source=Source(frame=documents(spark, sf_dir)), input_columns=["text", "lang"], forward_columns=["doc_id", "source", "absent"], output_columns=["keyword", "reason"], prompts=GENERIC_PROMPTS,
        num_samples_per_prompt=2, languages=LANGUAGES, expansion=Expansion({"style": STYLES["style"]}), skip_function=F.col("n_chars") < 200,
    )


def generic_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generic.generic_rows(spark, generic_config(spark, sf_dir), providers(), "doc_id", shown={"text": F.md5})
    about = F.col("metadata")
    return rows.withColumns({"prompt_index": about["prompt_index"], "source_row_index": about["source_row_index"]}).drop("metadata")


def _generic_sql() -> str:
    numbered = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS source_row_index FROM documents"
    values = {"num_samples": "2", "language": "language_name", "text": "text", "lang": "lang", "style": "style"}
    parts = [compile_template(p, ["num_samples", "language", "text", "lang"], ["style"]) for p in GENERIC_PROMPTS]
    variants = f"(SELECT 0 AS prompt_index, i::BIGINT AS expansion, v AS style FROM {_values_sql('s', STYLES['style'])} UNION ALL SELECT 1, 0::BIGINT, NULL) AS v"
    grid = f"SELECT *, CASE prompt_index WHEN 0 THEN {fill_sql(parts[0], values)} ELSE {fill_sql(parts[1], values)} END AS prompt FROM ({numbered}), {LANGUAGES_SQL}, {variants}, {MODELS_SQL} WHERE NOT n_chars < 200"
    return f"""SELECT {uuid_sql("42", "'generic'", "source_row_index", "language", "prompt_index", "expansion", "provider", "item")} AS uuid, {stub_sql("prompt", "model_id", "keyword", "item")} AS keyword,
        {stub_sql("prompt", "model_id", "reason", "item")} AS reason, model_id, 'synthetic' AS pipeline_source, language, md5(text) AS text, lang, doc_id::VARCHAR AS doc_id, source, '' AS absent,
        prompt_index::VARCHAR AS prompt_index, source_row_index::VARCHAR AS source_row_index FROM ({grid}), {ITEMS_SQL}"""


query(_generic_sql())(generic_pipeline)


@query("SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, value::VARCHAR AS value, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS high, '' AS missing FROM events")
def generic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    shown = generic.columns(rows, ["event_id", "user_id", "value", "high", "missing"])
    return rows.select(*(v.alias(c) for c, v in shown.items()))


@query(
    "SELECT * FROM (VALUES (0, 'uuid', 'string'), (1, 'keyword', 'string'), (2, 'reason', 'string'), (3, 'model_id', 'string'), (4, 'pipeline_source', 'string'), (5, 'language', 'string'), (6, 'text', 'string'), (7, 'lang', 'string'), (8, 'doc_id', 'string'), (9, 'source', 'string'), (10, 'metadata', 'map<string,string>')) AS t(place, name, type)"
)
def generic_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = schemas.generic_row(["text", "lang"], ["doc_id", "source"], ["keyword", "reason"]).fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "place int, name string, type string")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def metadata_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from promptgrid.plans.common import metadata

    rows = documents(spark, sf_dir).select(metadata(lang=F.col("lang"), source=F.col("source")).alias("metadata"))
    return rows.groupBy(F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source")).agg(F.count("*").alias("n"))


# --- counts ------------------------------------------------------------------------------------------------------


def _both(spark: SparkSession, expected: int, planned: DataFrame, samples: int) -> DataFrame:
    return spark.createDataFrame([(expected, expand.planned_rows(planned, samples))], "expected long, planned long")


def _product_sql(planned: str, *tables: str) -> str:
    """The closed formula, from the sizes of its lists, beside the count of the grid; two samples a prompt."""
    return f"SELECT 2 * {' * '.join(f'(SELECT count(*) FROM {t})' for t in tables)} AS expected, (SELECT 2 * count(*) FROM ({planned})) AS planned"


@query(_product_sql(_CLASS_GRID, _CLASSES_SQL, LANGUAGES_SQL, _STYLES_SQL, MODELS_SQL))
def expected_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, expand.expected_rows(CLASSIFICATION, 2), classification.grid(spark, CLASSIFICATION, providers()), 2)


@query(_product_sql(_RAW_GRID, "(VALUES ('letter'), ('report'))", "(VALUES ('rivers'), ('tides'), ('snow'))", LANGUAGES_SQL, _STYLES_SQL, MODELS_SQL))
def expected_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, expand.expected_rows(RAW, 2), raw.grid(spark, RAW, providers()), 2)


@query(_product_sql(_CHAT_GRID, _TOPICS_SQL, LANGUAGES_SQL, MODELS_SQL))
def expected_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, expand.expected_rows(CHAT, 2), chat_plan.grid(spark, CHAT, providers()), 2)


@query(f"SELECT count(*) * 8 AS expected, count(*) FILTER (WHERE {_WINDOWED}) * 8 AS planned FROM documents")
def expected_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _mcq(spark, sf_dir)
    return _both(spark, expand.expected_rows(config, 2, documents(spark, sf_dir).count()), mcq.grid(spark, config, providers(), "doc_id"), 2)


@query("SELECT count(*) * 4 AS expected, count(*) * 4 AS planned FROM documents")
def expected_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _preference(spark, sf_dir)
    return _both(spark, expand.expected_rows(config, 1, documents(spark, sf_dir).count()), preference.questions_grid(spark, config, "doc_id"), 2)


@query("SELECT count(*) * 2 * 2 * 2 * 3 AS expected, count(*) FILTER (WHERE NOT n_chars < 200) * 2 * 2 * 2 * 3 AS planned FROM documents")
def expected_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = generic_config(spark, sf_dir)
    return _both(spark, expand.expected_rows(config, 2, documents(spark, sf_dir).count()), generic.grid(spark, config, providers(), "doc_id"), 2)


@query(
    """SELECT 'first' AS stage, count(*) AS rows, count(*) AS asked, count(*) FILTER (WHERE source <> 'src3') AS ok, count(*) FILTER (WHERE source = 'src3') AS failed FROM documents
    UNION ALL SELECT 'second', count(*), count(*) FILTER (WHERE lang <> 'fr'), count(*) FILTER (WHERE lang <> 'fr'), 0 FROM documents WHERE source <> 'src3'"""
)
def progress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two stages counted while they were written; the second asks nothing for some rows."""
    rows = documents(spark, sf_dir).select("lang", F.concat(F.lit("from "), F.col("source"), F.lit(".")).alias("prompt"))
    with stage.recording() as records:
        first = stage.answered(stage.ask(rows, "prompt", [ScriptedProvider(failing=("from src3.",))], schemas.ANSWER, provider=None, name="first")).drop("reply")
        stage.ask(first.withColumn("prompt", F.when(F.col("lang") != "fr", F.col("prompt"))), "prompt", [StubProvider()], schemas.ANSWER, provider=None, name="second")
    return stage.totals(spark, records)


@query("SELECT 'texts' AS stage, 'scripted/scripted-1' AS provider, 'scripted/scripted-1: scripted failure' AS error, class AS label_name, language, n FROM (VALUES ('good', 'en', 14), ('good', 'fr', 14)) AS t(class, language, n)")
def run_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejects that a run of a pipeline keeps beside its output."""
    model = ScriptedProvider(failing=("for good:", ": good ("))
    model.provider_name = "scripted"
    done = run(classification.classification_rows, spark, CLASSIFICATION, [model, model], output=temporary(spark, "jsonl"))
    key = lambda c: F.get_json_object("keys", f"$.{c}").alias(c)
    return done.rejects.select("stage", "provider", "error", key("label_name"), key("language")).groupBy("stage", "provider", "error", "label_name", "language").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT {uuid_sql('42', q('classification'), 'label_name', 'language', 'expansion', 'provider', 'item')} AS uuid, {stub_sql('prompt', 'model_id', 'entries', 'item')} AS text, style, length FROM ({_CLASS_GRID}), {ITEMS_SQL}")
def run_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that two runs leave, one of which was repeated under its id, with the placeholder values they were made with."""
    path = temporary(spark, "jsonl")
    for run_id, models in (("a", providers()[:1]), ("b", providers()[1:]), ("a", providers()[:1])):
        run(_with_provider(run_id == "b"), spark, CLASSIFICATION, models, output=path, run_id=run_id)
    rows = spark.read.schema(schemas.CLASSIFICATION_ROW).json(path)
    return rows.select("uuid", "text", F.col("metadata")["style"].alias("style"), F.col("metadata")["length"].alias("length"))


def _with_provider(second: bool):
    """The pipeline with one of two providers, whose place is part of the rows' ids."""

    def rows(spark: SparkSession, config: ClassificationConfig, models: list) -> DataFrame:
        return classification.classification_rows(spark, config, [_Silent(), *models] if second else models)

    return rows


class _Silent(StubProvider):
    """Fails each request."""

    def complete(self, conversations, shape):
        raise RuntimeError("silent")


# --- sinks, split, card, views, policies -------------------------------------------------------------------------


def _rows_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))


_SINK = "SELECT doc_id, md5(text) AS digest, CASE WHEN lang <> 'fr' THEN lang END AS lang, source FROM documents"


@query("SELECT doc_id, md5(text) AS digest, lang = 'fr' AS null_kept FROM documents")
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.to_jsonl(_rows_with_nulls(spark, sf_dir), path := temporary(spark, "jsonl"))
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.md5(F.from_json("value", "text string")["text"]).alias("digest"), F.col("value").contains('"lang":null').alias("null_kept"))


@query(_SINK)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.to_csv(_rows_with_nulls(spark, sf_dir), path := temporary(spark, "csv"))
    back = readers.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "lang", F.get_json_object("metadata", "$.source").alias("source"))


@query(_SINK)
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    writers.to_parquet(_rows_with_nulls(spark, sf_dir), path := temporary(spark, "parquet"))
    return spark.read.parquet(path).select("doc_id", F.md5("text").alias("digest"), "lang", F.col("metadata")["source"].alias("source"))


_SPLIT = f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {digest_sql('42', 'doc_id')}, doc_id) <= (SELECT count(*) - ceil(count(*) * 0.2 - 1e-9) FROM documents) THEN 'train' ELSE 'test' END AS split FROM documents"


@query(_SPLIT)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.train_test(documents(spark, sf_dir).select("doc_id"), 0.8, "doc_id", SEED)


@query(f"SELECT doc_id, split, md5(text) AS digest, 'doc_id,lang,n_chars,source,text' AS columns, 'My Corpus V1' AS title FROM ({_SPLIT}) JOIN documents USING (doc_id)")
def hub_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("metadata", F.create_map().cast("map<string,string>"))
    path = writers.export(rows, temporary(spark, "hub"), "team/my-corpus_v1", 0.8, "doc_id", SEED)
    back = spark.read.parquet(f"{path}/data")
    title = spark.read.text(f"{path}/README.md", wholetext=True).select(F.regexp_extract("value", r"(?m)^pretty_name: (.*)$", 1)).first()[0]
    return back.select("doc_id", "split", F.md5("text").alias("digest"), F.lit(",".join(sorted(set(back.columns) - {"split"}))).alias("columns"), F.lit(title).alias("title"))


@query("SELECT source, 'My ' || upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS pretty FROM (SELECT DISTINCT source, lang FROM documents)")
def card_pretty_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("source", F.concat(F.lit("team/my-"), "lang", F.lit("_"), "source").alias("repo")).distinct()

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([card.pretty_name(r) for r in batch.column(1).to_pylist()], pa.string())], ["source", "pretty"])

    return rows.mapInArrow(named, "source string, pretty string")


@query("SELECT doc_id, 'Example 8 / ' || (SELECT count(*) FROM documents) AS label FROM documents ORDER BY doc_id LIMIT 1 OFFSET 7")
def inspect_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.numbered(documents(spark, sf_dir).select("doc_id"), "ordinal", "doc_id")
    return views.page(rows, "ordinal", 7, rows.count()).select("doc_id", "label")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {digest_sql('7', 'doc_id')}, doc_id) AS place FROM documents")
def inspect_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.ranked(documents(spark, sf_dir).select("doc_id"), "doc_id", 7, "place")


@query("SELECT md5(text) AS text, lang AS label, '' AS model_id, '{}' AS metadata FROM documents")
def inspect_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumnRenamed("lang", "label")
    return views.view(rows, "classification").withColumn("text", F.md5("text"))


@query(
    """SELECT event_id, n AS in_window, n >= 9 AS held FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS n FROM events)"""
)
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.request_window(table(spark, sf_dir, "events"), "event_type", "ts", 10).select("event_id", "in_window", "held")


@query("SELECT (n // 13)::INT AS batch, count(*) AS requests, 62.0::DOUBLE * (n // 13) AS started FROM range(200) AS r(n) GROUP BY n // 13")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each of 200 requests that are all there at once may start under 15 a minute, by a clock of its own."""
    now = [0.0]
    limit = RequestLimit(15, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    started = []
    for _ in range(200):
        limit.wait()
        limit.record(1)
        started.append((now[0],))
    rows = spark.createDataFrame(started, "started double").groupBy("started").agg(F.count("*").alias("requests"))
    return rows.select((F.col("started") / WAIT_TARGET).cast("int").alias("batch"), "requests", "started")


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE, true), (1, 5.0::DOUBLE, true), (2, 15.0::DOUBLE, true), (3, 15.0::DOUBLE, false)) AS t(refusals, waited, answered)")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider that refuses some times makes ``send`` wait, and whether it answers in the end."""
    rows = []
    for refusals in range(4):
        waits: list[float] = []
        model = ScriptedProvider(refused=refusals)
        try:
            model.send([model.conversation("hello", None)], None, sleep=waits.append)
            rows.append((refusals, sum(waits, 0.0), True))
        except RateLimitError:
            rows.append((refusals, sum(waits, 0.0), False))
    return spark.createDataFrame(rows, "refusals int, waited double, answered boolean")


def queries() -> dict[str, Query]:
    return {name.rstrip("_"): f for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name.rstrip("_"): sql for name, sql in _SQL.items()}
