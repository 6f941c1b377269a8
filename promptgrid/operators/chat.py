"""Conversations: personas, numbers of turns, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgrid.functions import hashing


def persona(personas: list[str], seed: int, *key: Column) -> Column:
    """One of the personas, by a seeded draw for the conversation."""
    if not personas:
        raise ValueError("chats need personas")
    return hashing.pick(F.array(*map(F.lit, personas)), seed, "persona", *key)


def turn_count(max_turns: int, probability: float, seed: int, *key: Column) -> Column:
    """1, plus a turn for each draw below ``probability`` until the first that isn't, at most ``max_turns``."""
    if max_turns == 1:
        return F.lit(1)
    ends = F.array(*(hashing.uniform(seed, "turn", t, *key) >= probability for t in range(1, max_turns)))
    first = F.array_position(ends, True).cast("int")
    return F.when(first > 0, first).otherwise(max_turns)


def messages_of(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, messages): each conversation's turns in order, as (role, content)."""
    collected = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role), F.col(text))))
    content = F.transform(collected, lambda m: F.struct(m[role].alias("role"), m[text].alias("content")))
    return rows.groupBy(key).agg(content.alias("messages"))


def opening(messages: Column) -> Column:
    return F.get(F.transform(messages, lambda m: m["content"]), F.lit(0))


def dialog_summary(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def formatted(messages: Column) -> Column:
    """Messages to be read: a role's name before each, blank lines between; other roles are capitalised."""

    def line(m: Column) -> Column:
        role = m["role"]
        known = F.when(role == "user", "User").when(role == "assistant", "Assistant").when(role == "system", "System")
        return F.concat(F.coalesce(known, F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substr(role, F.lit(2))))), F.lit(": "), F.coalesce(m["content"], F.lit("")))

    return F.array_join(F.transform(messages, line), "\n\n")


def request_window(events: DataFrame, key: str, at: str, rpm: int) -> DataFrame:
    """``events`` with the requests of the 60 seconds before each and whether the limiter would hold it: a request at
    time t counts those after t - 60 s and before it, and is held at ``max(1, int(rpm * 0.9))`` of them."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    recent = Window.partitionBy(key).orderBy("micros").rangeBetween(-60_000_000 + 1, -1)
    counted = events.withColumn("micros", micros).withColumn("in_window", F.count("*").over(recent)).drop("micros")
    return counted.withColumn("held", F.col("in_window") >= max(1, int(rpm * 0.9)))
