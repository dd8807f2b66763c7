"""Conversations as a stream: the state of a session is kept between batches by its id.

Needs the RocksDB state store provider. Messages are appended; everything else is overwritten each turn,
so an effective question never outlives its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loam.functions.text import GREETINGS, REPLY_PHRASES

OUTPUT = "session_id string, turn long, student_type string, asks_profile boolean, is_greeting boolean, question string, n_messages long"


def reply_type(text: str) -> str | None:
    low = text.strip().lower()
    return next((kind for kind, phrases in REPLY_PHRASES if any(p in low for p in phrases)), None)


def greets(text: str) -> bool:
    low = text.strip().lower()
    return low in GREETINGS or (len(low.split()) <= 3 and low.startswith(GREETINGS))


class Sessions(StatefulProcessor):
    """Per session: messages so far, the student type, whether it was asked for, the last question."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", "student_type string, asked boolean, last string")
        self.messages = handle.getListState("messages", "turn long, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        student_type, asked, last = self.profile.get() if self.profile.exists() else (None, False, None)
        n = sum(1 for _ in self.messages.get())
        out = []
        for row in pd.concat(list(rows)).sort_values("turn").itertuples():
            text, n = row.text or "", n + 1
            self.messages.appendValue((int(row.turn), text))
            reply = reply_type(text) if student_type is None and asked and n > 1 else None
            asks = student_type is None and n == 1
            question = last if reply else text
            student_type, asked, last = student_type or reply, asked or asks, text
            out.append((key[0], int(row.turn), student_type, asks, greets(text), question, n))
        self.profile.update((student_type, asked, last))
        yield pd.DataFrame(out, columns=["session_id", "turn", "student_type", "asks_profile", "is_greeting", "question", "n_messages"])

    def close(self) -> None:
        pass


def session_turns(messages: DataFrame) -> DataFrame:
    """The turns of a stream messages(session_id, turn, text), each with the state after it."""
    return messages.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
