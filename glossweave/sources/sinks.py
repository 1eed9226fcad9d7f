"""Results as files: marked texts, matches as JSON, and messages on their way out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import presentation as P


def write_texts(marked: DataFrame, path: str, column: str = "marked_text") -> None:
    """Texts with their ids, one JSON row each, so that line breaks inside a text survive."""
    marked.select("doc_id", F.col(column).alias("text")).write.mode("overwrite").json(path)


def write_matches(resolved: DataFrame, entities: DataFrame, path: str) -> None:
    """A JSON document of matches per text."""
    P.matches_json(resolved, entities).select("json").write.mode("overwrite").text(path)


def outbox(answers: DataFrame, limit: int = 4000) -> DataFrame:
    """(chat_id, no, method, payload): the calls that deliver answers (chat_id, text, optionally message_id and reply_markup).

    A text over ``limit`` goes in parts; only the last has the buttons.  An answer
    with a message id edits that message with its first part.
    """
    has = lambda c: F.col(c) if c in answers.columns else F.lit(None).cast("string")
    parts = answers.select("chat_id", has("message_id").cast("long").alias("message_id"), has("reply_markup").alias("reply_markup"), P.split_message(F.col("text"), limit).alias("parts"))
    each = parts.select("chat_id", "message_id", "reply_markup", F.size("parts").alias("n"), F.posexplode("parts").alias("no", "text"))
    edits = F.col("message_id").isNotNull() & (F.col("no") == 0)
    payload: Column = F.struct(
        "chat_id", F.when(edits, F.col("message_id")).alias("message_id"), P.to_html(F.col("text")).alias("text"), F.lit("HTML").alias("parse_mode"),
        F.when(F.col("no") == F.col("n") - 1, F.col("reply_markup")).alias("reply_markup"),
    )
    return each.select("chat_id", "no", F.when(edits, "edit").otherwise("send").alias("method"), F.to_json(payload).alias("payload"))


def callback_answers(clicks: DataFrame) -> DataFrame:
    """The calls that acknowledge clicks (callback_id, text)."""
    return clicks.select(F.lit("answer").alias("method"), F.to_json(F.struct(F.col("callback_id").alias("callback_query_id"), "text")).alias("payload"))


def deliver(messages: DataFrame, send: Callable[[str, str], None]) -> None:
    """Hand (method, payload) rows to ``send`` on the executors, those of a chat in order.

    A task that is run again delivers again; ``send`` has to make that harmless.
    """

    def run(rows: Iterator[Row]) -> None:
        for r in rows:
            send(r.method, r.payload)

    ordered = messages.repartition("chat_id").sortWithinPartitions("chat_id", "no") if "chat_id" in messages.columns else messages
    ordered.foreachPartition(run)
