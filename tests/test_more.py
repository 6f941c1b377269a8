"""Ordinals, replies of every kind, runs, logs, uploads, adapters, and every rule of the configurations."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from promptgrid import logs, schemas, storage
from promptgrid.config import ChatConfig, ClassificationConfig, Expansion, GenericConfig, MCQConfig, PreferenceConfig, RawConfig, Source
from promptgrid.operators import chat, filters, split, stage, views
from promptgrid.operators.order import numbered
from promptgrid.plans import chat_rows, classification_rows, generic_rows, mcq_rows, preference_rows, raw_rows, run
from promptgrid.providers import AnthropicProvider, GeminiProvider, OpenAIProvider, ScriptedProvider, StubProvider
from promptgrid.sources import card, readers, writers
from promptgrid.streaming.incremental import run_stream


@pytest.mark.parametrize("key", [None, "k"])
def test_every_row_gets_one_ordinal(spark, key):
    values = [1, 1, None, 2, 1, None, 7] * 9
    rows = numbered(spark.createDataFrame([(v, f"t{i % 3}") for i, v in enumerate(values)], "k int, place string").repartition(5), "n", key)
    got = rows.collect()
    assert rows.columns == ["k", "place", "n"] and sorted(r["n"] for r in got) == list(range(len(values)))
    assert sorted((r["k"] is not None, r["k"] or 0) for r in got) == sorted((v is not None, v or 0) for v in values)
    if key:
        in_order = [r["k"] for r in sorted(got, key=lambda r: r["n"])]
        assert in_order == sorted(in_order, key=lambda v: (v is not None, v or 0))
    # asked twice, the answer is the same
    assert sorted(map(str, rows.collect())) == sorted(map(str, got))
    assert numbered(rows.limit(0), "m", key).count() == 0


def test_split_in_order(spark):
    rows = split.train_test(spark.range(50).withColumnRenamed("id", "key").repartition(7), 0.8, "key", shuffle=False).collect()
    assert {r["key"] for r in rows if r["split"] == "train"} == set(range(40))


def test_ranks_over_several_ranges(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "key")
    one = sorted(map(tuple, split.ranked(df, "key", 3).collect()))
    monkeypatch.setattr(split, "RANGE_ROWS", 7)
    assert sorted(map(tuple, split.ranked(df, "key", 3).collect())) == one and sorted(r for _, r in one) == list(range(1, 501))


@pytest.mark.parametrize("reply", ['{"score": 3000000000, "assessment": "a"}', '{"score": 1e300, "assessment": "a"}', '{"score": 1, "assessment": "\\ud83d"}', '{"score": NaN, "assessment": "a"}', "[" * 50_000, "\\ud83d"])
def test_no_reply_ends_the_job(spark, reply):
    rows = spark.createDataFrame([(1, "odd"), (2, "fine")], "id int, prompt string")
    model = ScriptedProvider(canned={"odd": json.loads(f'"{reply}"') if reply.startswith("\\") else reply})
    got = {r["id"]: r for r in stage.ask(rows, "prompt", [model], schemas.JUDGEMENT, provider=None).collect()}
    assert got[1]["status"] == "failed" and got[1]["error"] and got[1]["reply"] is None
    assert got[2]["status"] == "ok" and 1 <= got[2]["reply"]["score"] <= 10


def test_a_reply_that_its_type_cannot_hold_is_a_failure():
    import pyarrow as pa

    found = [(None, {"a": 1}), (None, {"a": 2**40}), (None, None)]
    status, error, reply = stage._columns(found, ["p", "p", None], pa.struct([("a", pa.int32())]))
    assert status.to_pylist() == ["ok", "failed", "none"] and reply.to_pylist() == [{"a": 1}, None, None] and "stored" in error.to_pylist()[1]


def _model():
    """A class of its own function: what is defined beside a session can't be sent to executors."""
    pydantic = pytest.importorskip("pydantic")

    class Part(pydantic.BaseModel):
        name: str
        weight: float = pydantic.Field(ge=0, le=1)

    class Thing(pydantic.BaseModel):
        title: str
        year: int | None = None
        parts: list[Part] = pydantic.Field(min_length=1, max_length=2)
        good: bool = True

    return Thing


def test_reply_types_as_ddl_and_models(spark):
    Thing = _model()
    shape = schemas.shape_of(Thing)
    assert schemas.spark_type(shape).simpleString() == "struct<title:string,year:bigint,parts:array<struct<name:string,weight:double>>,good:boolean>"
    fine = {"title": "t", "parts": [{"name": "n", "weight": 0.5}]}
    assert schemas.parse(shape, json.dumps(fine)) == fine | {"year": None, "good": True}
    for bad in ({"title": "t", "parts": []}, {"title": "t", "parts": [{"name": "n", "weight": 2}]}, {"parts": fine["parts"]}, fine | {"year": "x"}):
        with pytest.raises(ValueError):
            schemas.parse(shape, json.dumps(bad))
    thing = StubProvider(entries=1).generate("one", response_format=Thing)
    assert isinstance(thing, Thing) and len(thing.parts) == 1
    asked = stage.ask(spark.createDataFrame([("p",)], "prompt string"), "prompt", [StubProvider(entries=2)], Thing, provider=None)
    assert asked.first()["status"] == "ok" and len(asked.first()["reply"]["parts"]) == 2
    ddl = schemas.shape_of("a string not null, b array<double>, c bigint")
    assert schemas.parse(ddl, '{"a": "x", "b": [1, 2.5]}') == {"a": "x", "b": [1.0, 2.5], "c": None}
    with pytest.raises(TypeError):
        schemas.shape_of("a map<string,string>")
    assert schemas.json_schema(schemas.JUDGEMENT) == {"type": "object", "properties": {"assessment": {"type": "string"}, "score": {"type": "integer"}}, "required": ["assessment", "score"], "additionalProperties": False}


def test_requests_carry_the_schema_and_the_key(monkeypatch):
    sent = []

    def post(self, body):
        sent.append((body, self.headers()))
        return {"choices": [{"message": {"content": '{"answer": "a"}'}}], "output": [{"type": "message", "content": [{"text": '{"answer": "a"}'}]}], "content": [{"type": "tool_use", "input": {"answer": "a"}}]}

    for kind in (OpenAIProvider, AnthropicProvider, GeminiProvider):
        monkeypatch.setattr(kind, "post", post)
        model = kind(api_key="k1")
        assert model.generate("q", response_format=schemas.ANSWER) == {"answer": "a"} and "k1" not in repr(model)
        assert "k1" in str(sent[-1][1]) and "additionalProperties" in json.dumps(sent[-1][0])
    monkeypatch.delenv("GEMINI_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="api_key"):
        GeminiProvider().generate("q")


CLASSES = [{"name": "a", "description": "x"}, {"name": "b", "description": "y"}]


def test_runs_leave_rows_rejects_and_totals(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    config = ClassificationConfig(classes=CLASSES, output_file=path)
    models = [StubProvider("m"), ScriptedProvider(failing=("class 'b'",))]
    tables = len(list((tmp_path / "..").iterdir()))
    one = run(classification_rows, spark, config, models)
    assert one.n_rows == one.rows.count() == 6 and one.rejects.count() == 1
    assert one.rejects.first()["provider"] == "stub/scripted-1" and json.loads(one.rejects.first()["keys"])["label_name"] == "b"
    assert tuple(one.totals.first()) == ("texts", 4, 4, 3, 1)
    run(classification_rows, spark, config, models, run_id=one.run_id)
    assert spark.read.json(path).count() == 6
    run(classification_rows, spark, config, models)
    assert spark.read.json(path).count() == 12
    run(classification_rows, spark, config, models, append=False)
    assert spark.read.json(path).count() == 6
    assert tables == len(list((tmp_path / "..").iterdir()))


def test_scopes_delete_their_tables(spark):
    with storage.scope(spark) as paths:
        assert storage.written(spark.range(3), "x").count() == 3
    import os

    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:"))


def test_stages_leave_texts_behind(spark):
    docs = spark.createDataFrame([(i, f"document {i} " * 50) for i in range(5)], "id long, text string")
    with stage.recording() as records:
        rows = preference_rows(spark, PreferenceConfig(input_documents=docs, llm_as_judge=True), StubProvider("q"), StubProvider("c"), StubProvider("r"), StubProvider("j"), "id")
        mcq = mcq_rows(spark, MCQConfig(source=Source(frame=docs), text_column="text"), [StubProvider(entries=3)], "id")
        generic = generic_rows(spark, GenericConfig(source=Source(frame=docs), input_columns=["text"], prompts=["{num_samples} {language} {text}"]), [StubProvider()], "id")
    assert len(records) == 1 + 2 + 2 + 2 + 1
    for r in records:
        assert not {"document", "prompt", "in_text"} & set(r.table.columns)
    assert rows.count() == 5 * 2 and mcq.count() == 5 * 3 and generic.count() == 5 * 2
    texts = {r["text"] for r in docs.collect()}
    assert {r[0] for r in rows.select("input_document").collect()} == {r[0] for r in mcq.select("source_document").collect()} == {r[0] for r in generic.select("text").collect()} == texts


def test_documents_that_repeat_each_other_stay_apart(spark):
    docs = spark.createDataFrame([(None, "same text"), (1, "same text"), (1, "same text")], "id long, text string")
    rows = preference_rows(spark, PreferenceConfig(input_documents=docs), StubProvider("q"), StubProvider("c"), StubProvider("r"), key="id")
    assert rows.count() == 3 * 2
    generic = generic_rows(spark, GenericConfig(source=Source(frame=docs), input_columns=["text"], prompts=["{num_samples} {language} {text}"]), [StubProvider()], "id")
    assert generic.count() == 3 * 2 and generic.select("uuid").distinct().count() == 6


def test_scores_out_of_range_are_marked(spark):
    judge = ScriptedProvider(canned={"Rate": '{"assessment": "a", "score": 11}'})
    row = preference_rows(spark, PreferenceConfig(input_documents=["d"], llm_as_judge=True), StubProvider("q", 1), StubProvider("c"), StubProvider("r"), judge).first()
    assert row["chosen_response_score"] == 11 and row["metadata"]["score_in_range"] == "false"


def test_a_failed_first_judgement_leaves_the_pair(spark):
    class Moody(StubProvider):
        def _one(self, prompt, shape):
            return RuntimeError("no") if "txt-" in prompt and prompt.count("first") else super()._one(prompt, shape)

    rows = preference_rows(spark, PreferenceConfig(input_documents=["d"], llm_as_judge=True, judge_prompt="{document} {question} {response}"), StubProvider("q", 1), ScriptedProvider("first", canned={"Answer": '{"answer": "first"}'}), StubProvider("r"), Moody("j"))
    row = rows.first()
    assert row["chosen_response"] == "first" and row["chosen_response_score"] is None and row["rejected_response_score"] is None


def test_frames_for_classes_topics_and_personas(spark):
    classes = spark.createDataFrame([("b", "y"), ("a", "x")], "name string, description string")
    one = {r["uuid"] for r in classification_rows(spark, ClassificationConfig(classes=classes), [StubProvider()]).collect()}
    assert one == {r["uuid"] for r in classification_rows(spark, ClassificationConfig(classes=CLASSES), [StubProvider()]).collect()}
    topics = spark.createDataFrame([("s",), ("t",)], "topic string")
    texts = raw_rows(spark, RawConfig(document_types=["letter"], topics=topics), [StubProvider()]).collect()
    assert {r["metadata"]["topic"] for r in texts} == {"s", "t"} and len(texts) == 4
    people = spark.createDataFrame([("p1",), ("p2",), (None,)], "who string")
    talks = chat_rows(spark, ChatConfig(topics_and_subtopics={"t": ["s"]}, personas=people, num_samples=2), [StubProvider(entries=8)]).collect()
    assert len(talks) == 8 and {r["persona"] for r in talks} == {"p1", "p2"}


def test_membership_and_pick(spark):
    df = spark.range(100).selectExpr("id", "case when id % 5 = 4 then null else id % 4 end AS grade")
    assert {r["grade"] for r in filters.among(df, "grade", [1, 2]).collect()} == {1, 2}
    picked = sorted(r["id"] for r in filters.among(df, "grade", [1, 2], 5, "id").collect())
    assert len(picked) == 5 and picked == sorted(r["id"] for r in filters.among(df.repartition(9), "grade", [1, 2], 5, "id").collect())
    assert filters.among(df, "grade", [], 5, "id").count() == 0 and filters.among(df, "grade", [3], 50, "id").count() == df.where("grade = 3").count()


def test_role_names_stay_whole(spark):
    rows = spark.createDataFrame([([("x" + "Y" * 12_000, "hello")],)], "m array<struct<role: string, content: string>>")
    assert rows.select(chat.formatted(F.col("m"))).first()[0] == "X" + "y" * 12_000 + ": hello"


def test_views_by_row_type(spark):
    assert [views.kind_of(k) for k in ("MCQRow", "TextClassificationRow", "ChatRow", "PreferenceDataset", "TextRow", "UltrachatDataset")] == ["mcq", "text_classification", "chat", "preference", "raw", "chat"]
    assert views.kind_of(schemas.MCQ_ROW) == "mcq" and views.kind_of(schemas.generic_row(["a"])) == "generic"
    with pytest.warns(UserWarning, match="no view"):
        assert json.loads(views.view(spark.createDataFrame([(1, None)], "a int, b string"), "other").first()[0]) == {"a": 1, "b": None}


def test_logs_rotate_as_text_and_json(tmp_path, monkeypatch, capsys):
    file = tmp_path / "log" / "run.log"
    file.parent.mkdir()
    monkeypatch.setattr(logs, "MAX_BYTES", 400)
    try:
        log = logs.configure("DEBUG", str(file), as_json=True)
        for i in range(20):
            log.debug("message %d", i)
        assert json.loads(file.read_text().splitlines()[-1])["message"] == "message 19"
        assert list(file.parent.glob("run.log.*.gz"))
        assert len(logs.configure("WARNING").handlers) == 1
        log.info("not shown")
        log.warning("shown")
        assert "WARNING" in capsys.readouterr().err
    finally:
        for h in list(logs.log.handlers):
            logs.log.removeHandler(h)
        logs.log.setLevel(logging.NOTSET)
        logs.log.propagate = True


class _Hub:
    def __init__(self, bad_card=False):
        self.calls, self.bad_card = [], bad_card

    def create_repo(self, repo_id, **options):
        self.calls.append(("create", repo_id, options["private"]))

    def upload_folder(self, **options):
        if self.bad_card and options["allow_patterns"] == ["README.md"]:
            raise OSError("refused")
        self.calls.append(("upload", options["folder_path"], options["allow_patterns"]))


def test_push(spark, tmp_path, monkeypatch, caplog):
    rows = spark.range(10).selectExpr("string(id) AS uuid", "'t' AS text", "map() AS metadata")
    monkeypatch.delenv("HF_TOKEN", raising=False)
    with pytest.raises(ValueError, match="HF_TOKEN"):
        writers.push(rows, "me/my-set", str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no rows"):
        writers.push(rows.limit(0), "me/my-set", str(tmp_path / "a"), token="t")
    hub = _Hub()
    assert writers.push(rows, "me/my-set", str(tmp_path / "a"), token="t", train_size=0.7, transport=hub) == "me/my-set"
    assert hub.calls == [("create", "me/my-set", True), ("upload", str(tmp_path / "a"), ["data/**/*.parquet"]), ("upload", str(tmp_path / "a"), ["README.md"])]
    text = (tmp_path / "a" / "README.md").read_text()
    assert "# My Set" in text and "| train | 7 |" in text and "| uuid | string |" in text and "metadata" not in text
    assert spark.read.parquet(str(tmp_path / "a" / "data")).columns == ["uuid", "text", "split"]
    writers.push(rows, "me/my-set", str(tmp_path / "b"), token="t", transport=_Hub(bad_card=True))
    assert "card was not uploaded" in caplog.text


def test_cards_keep_what_the_hub_wrote():
    before = "---\npretty_name: Old\ndataset_info:\n  features:\n  - name: a\nconfigs:\n- x: y\n---\n# Old\n"
    assert card.kept_block(before) == ["dataset_info:", "  features:", "  - name: a"]
    assert card.card_text("me/new_set", before).startswith("---\npretty_name: New Set\ndataset_info:\n  features:\n  - name: a\n---\n\n# New Set\n")
    for none in ("", "no front matter", "---\ndataset_info: {}\n"):
        assert card.kept_block(none) == []


def test_mirrored_hub_datasets(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(readers.MIRROR, str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "team" / "set" / "test"))
    spark.range(5).write.parquet(str(tmp_path / "team" / "set" / "train"))
    assert readers.load_source(spark, Source(hf_dataset_name="team/set")).count() == 5
    with pytest.raises(ValueError, match="loading"):
        readers.load_source(spark, Source(hf_dataset_name="team/none"))


def test_readers_take_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n01,x\n")
    (tmp_path / "b.jsonl").write_text('{"id": 1, "text": "x"}\n')
    assert readers.load_source(spark, Source(local_file_path=str(tmp_path / "a.csv"), schema="id string, text string")).first()["id"] == "01"
    assert readers.load_source(spark, Source(local_file_path=str(tmp_path / "b.jsonl"), schema="id string, more string")).first()["more"] is None


def test_a_stream_is_written_batch_by_batch(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "prompt string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("prompt string").parquet(str(tmp_path / "in"))
    ask = lambda batch: stage.ask(batch, "prompt", [StubProvider()], schemas.ANSWER, provider=None).select("prompt", "reply.answer")
    for _ in range(2):
        run_stream(rows, ask, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("c",)], "prompt string").write.mode("append").parquet(str(tmp_path / "in"))
    run_stream(rows, ask, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r["prompt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b", "c"}


FULL = "{num_samples} {language_name} {label_name} {label_description}"


@pytest.mark.parametrize(
    "make",
    [
        lambda: ClassificationConfig(classes=[{"name": "a"}]),
        lambda: ClassificationConfig(prompts=[FULL + " {{x}}"], expansion=Expansion({"x": []})),
        lambda: ClassificationConfig(prompts=[FULL + " {{x}}"], expansion=Expansion({"x": "abc"})),
        lambda: RawConfig(document_types=["a"], topics=[]),
        lambda: ChatConfig(max_turns=0),
        lambda: ChatConfig(question_generation_prompts=["{num_samples}"]),
        lambda: ChatConfig(persona_question_reformulation_prompt="{question}"),
        lambda: ChatConfig(simulated_assistant_prompt="{question}"),
        lambda: ChatConfig(user_followup_prompt="{persona}"),
        lambda: MCQConfig(source=Source(local_file_path="a.csv")),
        lambda: MCQConfig(source=Source(local_file_path="a.csv"), text_column="t", distractor_prompt="{question}"),
        lambda: PreferenceConfig(judge_prompt="{document}"),
        lambda: PreferenceConfig(chosen_response_generation_prompt="{document}"),
        lambda: GenericConfig(source=Source(local_file_path="a.csv"), input_columns=["language"], prompts=["{num_samples} {language}"]),
        lambda: GenericConfig(source=Source(local_file_path="a.csv"), input_columns=[], prompts=["{num_samples} {language}"]),
        lambda: GenericConfig(source=Source(local_file_path="a.csv"), input_columns=["a"], prompts=[]),
    ],
)
def test_rules_of_the_configurations(make):
    with pytest.raises(ValueError):
        make()


def test_warnings_of_the_configurations():
    with pytest.warns(UserWarning, match="more than 5"):
        RawConfig(document_types=["a"], topics=["b"], num_samples_per_prompt=6)
    with pytest.warns(UserWarning, match="leaves out b"):
        GenericConfig(source=Source(local_file_path="a.csv"), input_columns=["a", "b"], prompts=["{num_samples} {language} {a}"])


def test_custom_prompts_of_every_step_are_used(spark):
    class Seen(StubProvider):
        prompts: list = []

    given = {
        "question_generation_prompts": ["Q {num_samples} {language_name} {domain} {topic} {subtopic}"], "persona_question_reformulation_prompt": "R {question} {persona} {subtopic}",
        "simulated_assistant_prompt": "A {domain} {topic} {subtopic} {question}", "user_followup_prompt": "F {dialog_summary} {persona} {domain} {subtopic}",
    }
    config = ChatConfig(topics_and_subtopics={"t": ["s"]}, personas=["p"], max_turns=2, conversation_continuation_prob=1.0, **given)
    model = ScriptedProvider(canned={"Q 10": '{"questions": ["q"]}', "R q": '{"question": "r"}', "A Sci": '{"answer": "a"}', "F r\na": '{"question": "f"}', "f": '{"answer": "b"}'})
    row = chat_rows(spark, config, [model]).first()
    assert [m["content"] for m in row["messages"]] == ["r", "a", "f", "b"]
