"""The language model stage: the only place where Python sees rows, and where every row is asked about once.

A plain UDF would be evaluated again for each filter and projection above it, and a lazy stage once more for each
action. So the stage is ``mapInArrow`` and its result is written to the shared folder before anything reads it. A task
that is tried again asks again for its own rows only; ids come from lineage, so the rows keep their keys. What a prompt
was made of, its text above all, is left behind: a stage writes keys, bookkeeping and replies. Where every row is asked
about by a whole grid of prompts, ``ask_each`` makes them from the row that Python already has.

No reply can end the job: whatever doesn't parse, isn't of the shape, doesn't fit the columns' types or isn't text is that
row's failure. ``recording`` collects what the stages in it did: the rows that failed, with provider and error, and counts
observed while the stage was written.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from promptgrid import storage
from promptgrid.functions.template import Part, fill_text
from promptgrid.logs import log
from promptgrid.providers.base import Provider
from promptgrid.schemas import Shape, parse, shape_of, spark_type


@dataclass(frozen=True)
class Call:
    """One question to a row: the column of its prompt, who is asked, what comes back, and how it is called.

    prompt: a column of strings, or of conversations (arrays of role and content); null asks nothing (status none).
    provider: a column with the index into ``providers``; None stands for the first.
    """

    prompt: str
    providers: list[Provider]
    shape: Shape | None
    reply: str = "reply"
    provider: str | None = None
    status: str = "status"
    error: str = "error"


@dataclass
class Record:
    """A stage that ran: its name, its written table and the counts ``rows``, ``ok``, ``failed``, ``none`` and ``seconds``."""

    name: str
    table: DataFrame
    call: Call
    counts: dict[str, Any] = field(default_factory=dict)


_records: ContextVar[list[Record] | None] = ContextVar("records", default=None)


@contextmanager
def recording() -> Iterator[list[Record]]:
    """The records of all stages that run in it, in order."""
    records: list[Record] = []
    token = _records.set(records)
    try:
        yield records
    finally:
        _records.reset(token)


def _clean(error: str) -> str:
    return error.encode("utf-8", "replace").decode()


def _ask(provider: Provider, prompts: list, shape: Shape | None, limit, sleep) -> list[tuple[str | None, object]]:
    """(error, parsed reply) of each prompt of one batch."""
    try:
        replies = provider.send([provider.conversation(p, shape) for p in prompts], shape, limit, sleep)
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
    except Exception as e:
        return [(_clean(f"{provider.model()}: {e}"), None)] * len(prompts)
    out: list[tuple[str | None, object]] = []
    for reply in replies:
        try:
            if isinstance(reply, Exception):
                raise reply
            out.append((None, parse(shape, reply)))
        except Exception as e:
            out.append((_clean(f"{provider.model()}: {e}"), None))
    return out


def _columns(found: list[tuple[str | None, object]], prompts: list, arrow: pa.DataType) -> list[pa.Array]:
    """(status, error, reply) as columns; a reply that its type can't hold is a failure."""
    try:
        replies = pa.array([r for _, r in found], arrow)
    except Exception:
        for i, (_, reply) in enumerate(found):
            try:
                pa.array([reply], arrow)
            except Exception as e:
                found[i] = (_clean(f"reply can't be stored: {e}"), None)
        replies = pa.array([r for _, r in found], arrow)
    status = ["none" if p is None else "failed" if e is not None else "ok" for p, (e, _) in zip(prompts, found, strict=True)]
    return [pa.array(status, pa.string()), pa.array([e for e, _ in found], pa.string()), replies]


def ask_all(df: DataFrame, calls: list[Call], without: tuple[str, ...] = (), batch: int = 1, tasks: int | None = None, keep: bool = True, name: str = "stage") -> DataFrame:
    """``df`` with the status, error and parsed reply of each call, in one pass.

    without: columns that the stage reads and does not return. batch: prompts a request, which fail together if the
    request does. tasks: how many tasks ask at the same time; a provider's requests a minute are shared out among them
    (where there is such a limit, as many as the session's default parallelism unless given). keep: write the result
    once and read it back.
    """
    calls = [Call(c.prompt, c.providers, shape_of(c.shape), c.reply, c.provider, c.status, c.error) for c in calls]
    if tasks is None and any(p.rpm_limit is not None for c in calls for p in c.providers):
        tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = df if tasks is None else df.repartition(tasks)
    share = tasks or 1
    stay = [f for f in df.schema.fields if f.name not in without]
    kinds = [spark_type(c.shape) if c.shape is not None else StringType() for c in calls]
    new = [f for c, kind in zip(calls, kinds, strict=True) for f in (StructField(c.status, StringType()), StructField(c.error, StringType()), StructField(c.reply, kind))]
    schema = StructType([*stay, *new])
    names, arrows = [f.name for f in stay], [to_arrow_type(kind) for kind in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = [[p.limit(share) for p in c.providers] for c in calls]
        for part in batches:
            out = [part.column(n) for n in names]
            for call, arrow, limit in zip(calls, arrows, limits, strict=True):
                prompts = part.column(call.prompt).to_pylist()
                which = part.column(call.provider).to_pylist() if call.provider else [0] * len(prompts)
                found: list = [(None, None)] * len(prompts)
                for w in sorted(set(which)):
                    mine = [i for i, (x, p) in enumerate(zip(which, prompts, strict=True)) if x == w and p is not None]
                    for at in range(0, len(mine), batch):
                        these = mine[at : at + batch]
                        for i, result in zip(these, _ask(call.providers[w], [prompts[i] for i in these], call.shape, limit[w], time.sleep), strict=True):
                            found[i] = result
                out += _columns(found, prompts, arrow)
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    asked = rows.mapInArrow(run, schema)
    if not keep:
        return asked
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count_if(F.col(c.status) == s).alias(f"{s}_{i}") for i, c in enumerate(calls) for s in ("ok", "failed", "none")]
    began = time.monotonic()
    table = storage.written(asked.observe(seen, *counts), name)
    took, got = time.monotonic() - began, seen.get
    for i, call in enumerate(calls):
        of = {"rows": got.get("rows", 0)} | {s: got.get(f"{s}_{i}", 0) for s in ("ok", "failed", "none")} | {"seconds": took}
        log.info("%s: %d asked, %d failed, %.1f s", call.reply if len(calls) > 1 else name, of["ok"] + of["failed"], of["failed"], took)
        if (records := _records.get()) is not None:
            records.append(Record(name if len(calls) == 1 else f"{name} {call.reply}", table, call, of))
    return table


def ask(
    df: DataFrame, prompt: str, providers: list[Provider], shape: Shape | None, reply: str = "reply", provider: str | None = "provider", batch: int = 1, tasks: int | None = None, keep: bool = True,
    without: tuple[str, ...] = (), name: str = "stage",
) -> DataFrame:
    """``df`` with ``status`` (ok, failed or none), ``error`` and the parsed ``reply``: ``ask_all`` with one call."""
    return ask_all(df, [Call(prompt, providers, shape, reply, provider)], without, batch, tasks, keep, name)


#: Questions that ``ask_each`` asks before it sends their replies on, so that their memory is bounded.
AT_ONCE = 4096


def ask_each(
    df: DataFrame, cells: DataFrame, prompts: list[tuple[int, list[Part]]], providers: list[Provider], shape: Shape | None, without: tuple[str, ...] = (), texts: tuple[str, ...] = (), tasks: int | None = None, name: str = "stage",
) -> DataFrame:
    """``df`` with each of ``cells``, whose rows are numbered by ``cell``, and ``status``, ``error`` and the parsed ``reply``.

    prompts: of each cell the index into ``providers`` and the prompt's parts, whose fields are columns of ``df``; a null
    fills as ``None``. A row goes to Python once and is written once, with the list of its replies, however many cells
    there are. without: columns that the stage reads and does not return; texts: columns that it returns, but that are no
    keys of a row that failed. tasks: as in ``ask_all``; a row's cells are then spread over the tasks.
    """
    shape = shape_of(shape)
    spark = df.sparkSession
    if tasks is None and any(p.rpm_limit is not None for p in providers):
        tasks = spark.sparkContext.defaultParallelism
    share, only, asked = tasks or 1, storage.fresh(df, "only"), storage.fresh(df, "asked")
    rows = df if tasks is None else df.crossJoin(spark.range(len(prompts)).select(F.col("id").cast("int").alias(only))).repartition(tasks)
    stay = [f for f in df.schema.fields if f.name not in without]
    kind = spark_type(shape) if shape is not None else StringType()
    each = StructType([StructField("cell", IntegerType()), StructField("status", StringType()), StructField("error", StringType()), StructField("reply", kind)])
    schema = StructType([*stay, StructField(asked, ArrayType(each))])
    names, read = [f.name for f in stay], sorted({p.text for _, prompt in prompts for p in prompt if p.field})
    arrow, list_arrow, step = to_arrow_type(kind), to_arrow_type(ArrayType(each)), max(1, AT_ONCE // max(1, len(prompts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = [p.limit(share) for p in providers]
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                values = [part.column(c).to_pylist() for c in read]
                mine = [range(len(prompts))] * part.num_rows if tasks is None else [[k] for k in part.column(only).to_pylist()]
                found, at_cell, ends = [], [], [0]
                for i, these in enumerate(mine):
                    row = {c: v[i] for c, v in zip(read, values, strict=True)}
                    for k in these:
                        which, prompt = prompts[k]
                        found += _ask(providers[which], [fill_text(prompt, row)], shape, limits[which], time.sleep)
                    at_cell += these
                    ends.append(len(at_cell))
                flat = pa.StructArray.from_arrays([pa.array(at_cell, pa.int32()), *_columns(found, at_cell, arrow)], fields=list(list_arrow.value_type))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=list_arrow)], names=schema.names)

    seen = Observation()
    of_status = lambda s: F.sum(F.size(F.filter(asked, lambda a: a["status"] == s))).alias(s)
    began = time.monotonic()
    table = storage.written(rows.mapInArrow(run, schema).observe(seen, F.sum(F.size(asked)).alias("rows"), *map(of_status, ("ok", "failed", "none"))), name)
    took, got = time.monotonic() - began, seen.get
    counts = {s: got.get(s) or 0 for s in ("rows", "ok", "failed", "none")} | {"seconds": took}
    log.info("%s: %d asked, %d failed, %.1f s", name, counts["ok"] + counts["failed"], counts["failed"], took)
    out = table.select(*names, F.inline(asked)).join(F.broadcast(cells), "cell").drop("cell")
    if (records := _records.get()) is not None:
        records.append(Record(name, out.drop(*texts), Call("prompt", providers, shape, provider="provider"), counts))
    return out


def answered(df: DataFrame) -> DataFrame:
    """Rows with a reply, without the stage's bookkeeping."""
    return df.where("status = 'ok'").drop("status", "error")


def failures(records: list[Record]) -> DataFrame | None:
    """(stage, provider, error, keys) of every row that failed, the row's small columns being shown as JSON; None without
    stages."""
    out = None
    for r in records:
        keys = [c for c, kind in r.table.dtypes if c not in (r.call.status, r.call.error, r.call.reply) and not kind.startswith(("array", "struct"))]
        who = F.array(*(F.lit(p.model()) for p in r.call.providers))[F.coalesce(F.col(r.call.provider), F.lit(0)) if r.call.provider else F.lit(0)]
        one = r.table.where(F.col(r.call.status) == "failed").select(F.lit(r.name).alias("stage"), who.alias("provider"), F.col(r.call.error).alias("error"), F.to_json(F.struct(*keys) if keys else F.struct(F.lit(1))).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def totals(spark, records: list[Record]) -> DataFrame:
    """(stage, rows, asked, ok, failed): what the stages counted while they were written."""
    rows = [(r.name, r.counts["rows"], r.counts["ok"] + r.counts["failed"], r.counts["ok"], r.counts["failed"]) for r in records]
    return spark.createDataFrame(rows, "stage string, rows long, asked long, ok long, failed long")


def explode_reply(df: DataFrame, items: str, ordinal: str = "item", value: str = "entry") -> DataFrame:
    """A row for each element of a reply's list, however many came; ``ordinal`` from 0."""
    return df.select("*", F.posexplode(F.col(items)).alias(ordinal, value))
