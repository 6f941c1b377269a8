"""A pipeline from its configuration to its output file: rows, rejects and totals under a run id."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from promptgrid import storage
from promptgrid.logs import log
from promptgrid.operators import stage
from promptgrid.sources import writers


@dataclass(frozen=True)
class Outcome:
    """What a run left: its id, where its rows are and how many, the rows that failed, and the stages' counts."""

    run_id: str
    path: str
    rows: DataFrame
    n_rows: int
    rejects: DataFrame | None
    totals: DataFrame


def run(pipeline: Callable[..., DataFrame], spark: SparkSession, config: Any, *providers: Any, output: str | None = None, run_id: str | None = None, append: bool = True, keep_tables: bool = False, **options: Any) -> Outcome:
    """Runs a pipeline and writes its rows as JSON Lines to ``<output_file>/run=<id>`` and its failures, as Parquet, to
    ``<output_file>.rejects/run=<id>``.

    Runs add to each other; one that is repeated under its id replaces what it wrote and nothing else. Without ``append``
    the output of all earlier runs goes first. The tables of the stages go at the end unless ``keep_tables``.
    """
    run_id = run_id or uuid.uuid4().hex
    path = output or config.output_file
    with storage.scope(spark, keep_tables), stage.recording() as records:
        rows = pipeline(spark, config, *providers, **options)
        schema = rows.schema
        if not append:
            for old in (path, f"{path}.rejects"):
                storage.delete_path(spark, old)
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/run={run_id}")
        failed = stage.failures(records)
        rejects = None
        if failed is not None:
            failed.write.mode("overwrite").parquet(f"{path}.rejects/run={run_id}")
            rejects = spark.read.schema(failed.schema).parquet(f"{path}.rejects/run={run_id}")
        totals = stage.totals(spark, records)
    written = spark.read.schema(schema).json(f"{path}/run={run_id}")
    n = written.count()
    log.info("run %s: %d rows in %s", run_id, n, path)
    return Outcome(run_id, path, written, n, rejects, totals)
