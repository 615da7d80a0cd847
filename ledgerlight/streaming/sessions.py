"""The session ledger over a stream of messages: the batch fold's own code, with its state kept by Spark.

Input: session, turn, text, asked, and ts for the timeout. State: the ledger as JSON, dropped after the last turn or
when a session has been silent for the timeout. Output, append mode: a row for each message, as replay() gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conversation import TURN_SCHEMA, Ledger, turn_row

MAX_TURNS = 10


def ledger_stream(messages: DataFrame, gazetteer: Mapping[str, tuple[str, str]], timeout_ms: int = 3_600_000) -> DataFrame:
    longest = max((len(p.split()) for p in gazetteer), default=1)
    known = dict(gazetteer)
    columns = [c.split()[0] for c in TURN_SCHEMA.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger, turns = Ledger(), 0
        if state.exists:
            text, turns = state.get
            held = json.loads(text)
            held["concepts"] = [tuple(c) for c in held["concepts"]]
            ledger = Ledger(**held)
        rows = pd.concat(list(batches)).sort_values(["turn", "text"])  # a session has at most MAX_TURNS turns
        out = []
        for turn, text, asked in zip(rows["turn"], rows["text"], rows["asked"], strict=True):
            turns += 1
            if turns <= MAX_TURNS:
                out.append(turn_row(str(key[0]), int(turn), text, asked or None, ledger, known, longest))
        state.update((json.dumps(asdict(ledger)), turns))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = messages.selectExpr("cast(session as string) as session", "cast(turn as int) as turn", "text", "cast(asked as string) as asked")
    return rows.groupBy("session").applyInPandasWithState(fold, TURN_SCHEMA, "ledger string, turns int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_trace(rows: DataFrame, path: str, checkpoint: str):
    """An append-only trace of JSON files."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
