"""The review service as a stream: messages are annotated, unclear ones open a session that clicks then drive.

A session is keyed state with a sliding time to live; every click that needs it
renews it.  One answer row comes out per event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.presentation import decode_callback, default_selection, review_candidates

TTL_SECONDS, PAGE_SIZE = 1800, 5
EVENTS = "session_id string, event_id long, at timestamp, action string, value string, text string, candidate_ids array<string>, group_ids array<string>, ambiguous array<boolean>, selected array<string>"
STATE = "text string, candidate_ids array<string>, group_ids array<string>, ambiguous array<boolean>, selected array<string>, page int, expires double"
ANSWERS = "session_id string, event_id long, action string, status string, page int, total_pages int, selected array<string>, text string"
#: Answers by status: created, shown, cancelled, applied, unavailable.


class Session:
    """What one session does with its events, in order."""

    def __init__(self, state: tuple | None, ttl: float = TTL_SECONDS, page_size: int = PAGE_SIZE):
        names = [c.split()[0] for c in STATE.split(", ")]
        self.s = dict(zip(names, state)) if state else None
        self.ttl, self.page_size = ttl, page_size

    def _toggle(self, i: int) -> None:
        s = self.s
        if not 0 <= i < len(s["candidate_ids"]):
            raise IndexError(i)
        target, chosen = s["candidate_ids"][i], list(s["selected"])
        if target in chosen:
            chosen.remove(target)
        else:
            rivals = {c for c, g, a in zip(s["candidate_ids"], s["group_ids"], s["ambiguous"]) if a and g == s["group_ids"][i]} if s["ambiguous"][i] else set()
            chosen = [c for c in chosen if c not in rivals] + [target]
        s["selected"] = sorted(chosen)

    def handle(self, e: dict) -> dict:
        now = e["at"].timestamp()
        if self.s and self.s["expires"] < now:
            self.s = None
        status, text = "unavailable", None
        try:
            if e["action"] == "create":
                self.s = {"text": e["text"], "candidate_ids": [str(x) for x in e["candidate_ids"]], "group_ids": [str(x) for x in e["group_ids"]], "ambiguous": [bool(x) for x in e["ambiguous"]], "selected": sorted(map(str, e["selected"])), "page": 1, "expires": float(now + self.ttl)}
                status = "created"
            elif self.s and e["action"] in ("toggle", "page"):
                if e["action"] == "toggle":
                    self._toggle(int(e["value"]))
                else:
                    self.s["page"] = int(e["value"])
                self.s["expires"] = float(now + self.ttl)
                status = "shown"
            elif self.s and e["action"] in ("cancel", "apply"):
                status = {"cancel": "cancelled", "apply": "applied"}[e["action"]]
                text = self.s["text"] if status == "applied" else None
        except (ValueError, TypeError, IndexError):
            status = "unavailable"
        pages = max(1, -(-len(self.s["candidate_ids"]) // self.page_size)) if self.s else 0
        answer = {"session_id": e["session_id"], "event_id": e["event_id"], "action": e["action"], "status": status, "page": min(max(1, self.s["page"]), pages) if self.s else 0, "total_pages": pages, "selected": list(self.s["selected"]) if self.s else [], "text": text}
        if status in ("cancelled", "applied"):
            self.s = None
        return answer

    def state(self) -> tuple | None:
        return tuple(self.s.values()) if self.s else None


def _ordered(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values(["at", "event_id"], kind="stable").to_dict("records")


def replay(events: DataFrame, ttl: float = TTL_SECONDS, page_size: int = PAGE_SIZE) -> DataFrame:
    """Answers to a finished table of events, in batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session(None, ttl, page_size)
        return pd.DataFrame([session.handle(e) for e in _ordered(pdf)], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return events.groupBy("session_id").applyInPandas(run, ANSWERS)


def answers(events: DataFrame, ttl: float = TTL_SECONDS, page_size: int = PAGE_SIZE) -> DataFrame:
    """Answers to a stream of events; sessions that were idle too long in event time leave the state store."""
    columns = [c.split()[0] for c in ANSWERS.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(state.get if state.exists else None, ttl, page_size)
        rows = [session.handle(e) for e in _ordered(pd.concat(list(parts)))]
        if (kept := session.state()) is None:
            if state.exists:
                state.remove()
        else:
            state.update(kept)
            state.setTimeoutTimestamp(max(int(session.s["expires"] * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=columns)

    timed = events.withWatermark("at", f"{int(ttl)} seconds")
    return timed.groupBy("session_id").applyInPandasWithState(run, ANSWERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def route(messages: DataFrame) -> DataFrame:
    """``route`` of messages (chat_id, text): ignored, command or text; the trimmed text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return messages.withColumn("text", text).withColumn("route", F.when(text == "", "ignored").when(text.startswith("/"), "command").otherwise("text"))


def is_admin(chat_id: Column, admins: list[int]) -> Column:
    return F.lit(True) if not admins else chat_id.isin(admins)


def sessions_of(resolved: DataFrame) -> DataFrame:
    """Create events for documents with unclear mentions; the others can be marked at once."""
    c = review_candidates(resolved)
    pick = lambda name: F.transform("candidates", lambda x: x[name])
    return c.where("ambiguous_count > 0").select("doc_id", "text", pick("candidate_id").alias("candidate_ids"), pick("group_id").alias("group_ids"), pick("is_ambiguous").alias("ambiguous"), default_selection(F.col("candidates")).alias("selected"))


def clicks(callbacks: DataFrame) -> DataFrame:
    """Events of callbacks (event_id, at, data); unreadable data becomes the action ``unknown``."""
    d = decode_callback(F.col("data"))
    none = F.lit(None)
    return callbacks.select(
        F.coalesce(d.session, F.lit("")).alias("session_id"), "event_id", "at", F.coalesce(d.action, F.lit("unknown")).alias("action"), d.value.alias("value"), none.cast("string").alias("text"),
        none.cast("array<string>").alias("candidate_ids"), none.cast("array<string>").alias("group_ids"), none.cast("array<boolean>").alias("ambiguous"), none.cast("array<string>").alias("selected"),
    )
