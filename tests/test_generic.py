"""The generic pipeline, which asks about a source row with a grid of prompts."""

import json

import pytest
from pyspark.sql import functions as F

from promptgrid import schemas, storage
from promptgrid.config import Expansion, GenericConfig, Source
from promptgrid.operators import stage
from promptgrid.plans import generic
from promptgrid.providers import ScriptedProvider, StubProvider

ROWS = [(1, "a {style} {text}", 0.5, "x"), (2, None, None, None), (3, "", 1e20, "y"), (4, "été \\ \n", 2.0, "z"), (5, "same", 1.0, "x"), (6, "same", 1.0, "x")]


def _config(spark, rows=ROWS, **more):
    source = Source(frame=spark.createDataFrame(rows, "id long, text string, n double, kind string"))
    prompts = ["{num_samples} {language} {{style}} {text} {n} {{prompt_index}}", "{{{{x y}}}} {n} {num_samples} {language} {text}"]
    some = {"source": source, "input_columns": ["text", "n"], "forward_columns": ["kind", "text", "none"], "output_columns": ["k"], "prompts": prompts, "languages": {"en": "English", "fr": "French"}}
    return GenericConfig(**some | {"expansion": Expansion({"style": ["formal", "plain"], "prompt_index": ["i"]})} | more)


@pytest.mark.parametrize("expansion", [Expansion({"style": ["formal", "plain"], "prompt_index": ["i"]}), Expansion({"style": ["a", "b", "c"], "prompt_index": ["i"]}, combinatorial=False, num_random_samples=5)])
@pytest.mark.parametrize("rpm", [None, 60_000])
def test_replies_are_those_to_the_grid_of_prompts(spark, expansion, rpm):
    config, models = _config(spark, expansion=expansion), [StubProvider("a", 2, rpm_limit=rpm), StubProvider("b", 2, rpm_limit=rpm)]
    want = stage.ask(generic.grid(spark, config, models, "id"), "prompt", models, schemas.generic_reply(["k"]))
    want = stage.explode_reply(want, "reply.entries").select("source_row_index", "language", "prompt_index", "model_id", "in_text", "in_n", "fw_kind", "fw_none", F.coalesce(F.col("values")["style"], F.lit("-")), "entry.k")
    about = F.col("metadata")
    got = generic.generic_rows(spark, config, models, "id").select(about["source_row_index"], "language", about["prompt_index"], "model_id", "text", "n", "kind", "none", F.coalesce(about["style"], F.lit("-")), "k", "uuid")
    rows = sorted(tuple(map(str, r)) for r in got.collect())
    assert [r[:-1] for r in rows] == sorted(tuple(map(str, r)) for r in want.collect())
    assert len({r[-1] for r in rows}) == len(rows) > 0


def test_a_source_row_is_written_once_and_never_joined(spark, monkeypatch):
    """However many prompts it gets: its text crosses to Python, and to disk, once."""
    tables, real = {}, storage.written

    def kept(df, name):
        tables[name] = real(df, name)
        return tables[name]

    monkeypatch.setattr(storage, "written", kept)
    whole = generic.generic_rows(spark, _config(spark), [StubProvider("a"), StubProvider("b")], "id")
    assert tables["entries"].count() == len(ROWS)
    rows = generic.generic_rows(spark, _config(spark), [StubProvider("a"), StubProvider("b")], "id", shown={"text": F.md5})
    assert tables["entries"].count() == len(ROWS) and "in_text" not in tables["entries"].columns
    for plan in (r._jdf.queryExecution().executedPlan().toString() for r in (whole, rows)):
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(map(str, rows.collect())) == sorted(map(str, whole.withColumn("text", F.md5("text")).collect()))


def test_failures_have_keys_without_texts(spark):
    with stage.recording() as records:
        rows = generic.generic_rows(spark, _config(spark, [r for r in ROWS if r[1]]), [ScriptedProvider("a", failing=("same",)), StubProvider("b")], "id")
    assert records[0].counts["failed"] == 2 * 2 * 3 and records[0].counts["rows"] == 4 * 2 * 3 * 2 == records[0].counts["ok"] + records[0].counts["failed"]
    failed = stage.failures(records).collect()
    assert len(failed) == 12 and {r["provider"] for r in failed} == {"stub/a"} and all("same" not in r["keys"] for r in failed)
    assert {json.loads(r["keys"])["source_row_index"] for r in failed} == {2, 3} and rows.count() == (48 - 12) * 2


def test_no_rows(spark):
    with stage.recording() as records:
        assert generic.generic_rows(spark, _config(spark, []), [StubProvider()], "id").count() == 0
    assert records[0].counts["rows"] == 0
