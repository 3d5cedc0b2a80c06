"""The outcome log: commands with an expected version and an idempotency key, answered in the order of their times.

``commands`` has request_id, at, client_id, subject_type, subject_id, actor_type, actor_id, idempotency_key, value, expected_version,
source_reference and surfaced.  A command is refused if its posting wasn't surfaced for the client, or if its expected
version isn't the subject's; otherwise it is the subject's next version.  The same request again, under the same key, gets the first
answer again, whatever happened since; another request under a key that has an answer is refused.  Refused commands leave nothing behind.
Answers are known for ``KEEP`` after they were given.

``answered`` folds a table, ``answers`` a stream.  The stream holds commands back until the watermark has passed them, so
files may come in any order, late by no more than the watermark's delay, and repeated.
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: How long an idempotency key is known.
KEEP = datetime.timedelta(days=30)
COMMAND = (
    "request_id string, at timestamp, client_id string, subject_type string, subject_id string, actor_type string, actor_id string, "
    "idempotency_key string, value string, expected_version long, source_reference string, surfaced boolean"
)
_GIVEN = "status string, version long, previous_version long, previous_value string, value string, event_id string"
ANSWER = f"client_id string, request_id string, {_GIVEN}"
_NAMES, _ANSWERED = ([field.split()[0] for field in ddl.split(", ")] for ddl in (COMMAND, ANSWER))
_SUBJECT, _KEY = ("subject_type", "subject_id"), ("actor_type", "actor_id", "idempotency_key")


def request_digest(command: dict) -> str:
    """Of everything that makes the request, and not of when and how often it came."""
    said = {c: command[c] for c in ("client_id", *_SUBJECT, *_KEY, "value", "source_reference")} | {"expected_version": int(command["expected_version"] or 0)}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def decide(command: dict, head: tuple[int, str | None], earlier: tuple | None) -> tuple[tuple, bool]:
    """The answer (fields of ``_GIVEN``) to a command, and whether it is new; ``head`` is the subject's version and value,
    ``earlier`` the digest, time and answer known for the command's key."""
    version, value = head
    digest = request_digest(command)
    if earlier is not None and command["at"] - earlier[1] <= KEEP:
        return (("replayed", *earlier[2:]) if earlier[0] == digest else ("incompatible", *_nothing(head))), False
    if not command["surfaced"]:
        return ("not_surfaced", *_nothing(head)), False
    if version != command["expected_version"]:
        return ("stale", *_nothing(head)), False
    name = "\x1f".join([str(command[c]) for c in ("client_id", *_SUBJECT)] + [str(version + 1)])
    return ("accepted", version + 1, version, value, command["value"], hashlib.sha256(name.encode()).hexdigest()[:32]), True


def _nothing(head: tuple[int, str | None]) -> tuple:
    return head[0], None, None, head[1], None


def answered(commands: DataFrame, scope: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """The answers to all commands of a table.

    A ``scope`` (where keys are unique) is folded in order in one task, its rows streaming through; narrow it by the subject where
    keys are never shared between subjects, and a busy client's subjects spread over tasks.
    """
    turn = commands.select(*_NAMES).repartition(*scope).sortWithinPartitions(*scope, "at", "request_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, heads, known = None, {}, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                command = _plain(row._asdict())
                if (own := tuple(command[c] for c in scope)) != last:
                    last, heads, known = own, {}, {}
                subject, key = tuple(command[c] for c in _SUBJECT), tuple(command[c] for c in _KEY)
                given, new = decide(command, heads.get(subject, (0, None)), known.get(key))
                if new:
                    heads[subject] = given[1], given[4]
                    known[key] = (request_digest(command), command["at"], *given[1:])
                out.append((command["client_id"], command["request_id"], *given))
            yield _frame(out)

    return turn.mapInPandas(fold, ANSWER)


def _plain(command: dict) -> dict:
    """A command without pandas' markers of missing values."""
    return {c: None if pd.isna(v) else v for c, v in command.items()} | {"surfaced": bool(command["surfaced"] is not None and command["surfaced"])}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_ANSWERED)
    return out.astype({c: "Int64" for c in ("version", "previous_version")})


class Outcomes(StatefulProcessor):
    """A scope's commands, held until the watermark has passed them; its subjects' heads; its answers until they expire."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", COMMAND)
        self.heads = handle.getMapState("heads", "subject_type string, subject_id string", "version long, value string")
        self.known = handle.getMapState("known", "actor_type string, actor_id string, idempotency_key string", "digest string, at timestamp, version long, previous_version long, previous_value string, value string, event_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            arrived = [_plain(r._asdict()) for r in batch[_NAMES].itertuples(index=False)]
            self.waiting.appendList([tuple(c.values()) for c in arrived])
            for at in {_millis(c["at"]) for c in arrived}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        held = [dict(zip(_NAMES, r)) for r in self.waiting.get()]
        due = sorted((c for c in held if _millis(c["at"]) <= passed), key=lambda c: (c["at"], c["request_id"]))
        later = [tuple(c.values()) for c in held if _millis(c["at"]) > passed]
        self.waiting.put(later) if later else self.waiting.clear()
        for name in [k for k, v in self.known.iterator() if passed - _millis(v[1]) > KEEP.total_seconds() * 1000]:
            self.known.removeKey(name)
        out = []
        for command in due:
            subject, name = tuple(command[c] for c in _SUBJECT), tuple(command[c] for c in _KEY)
            head = tuple(self.heads.getValue(subject)) if self.heads.containsKey(subject) else (0, None)
            earlier = tuple(self.known.getValue(name)) if self.known.containsKey(name) else None
            given, new = decide(command, head, earlier)
            if new:
                self.heads.updateValue(subject, (given[1], given[4]))
                self.known.updateValue(name, (request_digest(command), command["at"], *given[1:]))
                self.handle.registerTimer(_millis(command["at"]) + int(KEEP.total_seconds() * 1000) + 1)
            out.append((command["client_id"], command["request_id"], *given))
        if out:
            yield _frame(out)

    def close(self) -> None:
        pass


def _millis(at: datetime.datetime) -> int:
    """Whole milliseconds that a time is not after."""
    return -int(-at.timestamp() * 1000 // 1)


def answers(commands: DataFrame, late: str, scope: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """The answers to a stream of commands that come no later than ``late``; needs the RocksDB state store."""
    held = commands.select(*_NAMES).withWatermark("at", late).groupBy(*scope)
    return held.transformWithStateInPandas(Outcomes(), ANSWER, "append", "eventtime")
