"""Repair of conversations whose messages are missing, repeated or out of turn.

A conversation should read: perhaps a system message, then user and assistant by
turns, ending with the assistant; or nothing. Edits of stated costs bring it
there: keep a message, give it the other role, delete it, insert an empty one.
The cheapest list of edits is found by dynamic programming over four states
(nothing yet, after a system message, after a user's, after an assistant's).

One shuffle brings each conversation to one partition; all else streams through
partitions that Spark sorts (its sorter spills), with Arrow batches of any size
and nothing held but the state between two rows:

1. a window over equal messages marks those seen earlier;
2. from the last message back, the cost from each state to the end is carried
   from batch to batch, as differences, of which there are few: each combination
   of differences and kind of message is worked out once. A row gets one byte of
   backpointers, two bits for the best edit from each state. Spark's sort
   back to the order of turns spills these bytes where a conversation is giant;
3. from the first message on, the backpointers are followed, and the repaired
   messages, counts, costs and digest come out.

Edits are tried in the order of their letters (D, I, K, R) and a cheaper one is
needed to displace an earlier one, so of equally cheap lists the one that comes
first in ASCII is taken. A conversation is never held whole; its audit has one
letter a message. One conversation is walked by one task: its digest is of one
sequence.

Nulls and odd rows: a null role or text counts as one space. Null turns come
first; messages of one turn are ordered by role, then text. A null id is a
conversation of its own. Roles are judged by their first letter; an empty role has
no letter and is passed over. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of a message that stays although it is cut short.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5

#: Two-bit codes of the edits, in ASCII order of their letters.
LETTERS = "DIKR"
_D, _I, _K, _R = range(4)

#: States: nothing yet, after a system message, after a user's, after an assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ENDS = (_START, _ASSISTANT)
#: The state that a user's or an assistant's message leads to: just one fits.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

def kept_state(state: int, letter: str) -> int | None:
    """Where a message that stays as it is leads to, or None where it doesn't fit."""
    if letter == "":
        return state
    if letter == "s" and state == _START:
        return _SYSTEM
    if letter == ("u" if _NEXT[state] == _USER else "a"):
        return _NEXT[state]
    return None


class Steps:
    """One step of the programme, from the costs behind a message to those before it.

    Costs are kept less their smallest; the pairs (differences, kind of message)
    that turn up are few, and each is worked out once per worker.
    """

    #: Costs to the end where no message is left: inserts until a state that may be last.
    LAST = (0, 2 * INSERT, INSERT, 0)

    def __init__(self) -> None:
        self._known: dict[tuple, tuple[tuple[int, ...], int]] = {}

    def step(self, after: tuple[int, ...], letter: str, fault: int) -> tuple[tuple[int, ...], int]:
        """(costs before the message less their smallest, backpointers)"""
        found = self._known.get((after, letter, fault))
        if found is None:
            found = self._known[after, letter, fault] = self._work_out(after, letter, fault)
        return found

    @staticmethod
    def _work_out(after: tuple[int, ...], letter: str, fault: int) -> tuple[tuple[int, ...], int]:
        stays = fault not in (BLANK, DUPLICATE)
        extra = CUT_SHORT if fault == TRUNCATED else 0
        direct = []
        for state in range(4):
            costs = [DELETE + after[state], None, None, None]
            if stays:
                kept = kept_state(state, letter)
                costs[_K] = None if kept is None else KEEP + extra + after[kept]
                costs[_R] = REROLE + extra + after[_NEXT[state]]
            direct.append(costs)
        # Inserts before this message: any number, each to the only state it fits.
        best = [min(c for c in costs if c is not None) for costs in direct]
        for _ in range(2):
            best = [min(best[q], INSERT + best[_NEXT[q]]) for q in range(4)]
        moves = 0
        for state in range(4):
            direct[state][_I] = INSERT + best[_NEXT[state]]
            choice = next(e for e in range(4) if direct[state][e] == best[state])
            moves |= choice << (2 * state)
        low = min(best)
        return tuple(b - low for b in best), moves


def _null_space(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(" "))


def messages(
    df: DataFrame, conversation: str, turn: str, role: str, text: str, code: Column | None = None
) -> DataFrame:
    """(conv, turn, role, text): ids as text, null roles and texts as one space;
    and ``code`` if there is one."""
    return df.select(
        F.col(conversation).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        _null_space(F.col(role).cast("string")).alias("role"),
        _null_space(F.col(text).cast("string")).alias("text"),
        *([] if code is None else [code.alias("code")]),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Bring each conversation to one partition and add ``letter`` and ``fault``.

    Rows whose ``role`` is null stand for a conversation that may have lost all
    its messages; they have no fault and are passed over later.
    """
    dealt = rows.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("turn"))
    # Only what is at the end matters; a pattern over the whole text would be tried everywhere.
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    fault = (
        F.when(F.col("role").isNull(), NONE)
        .when(last == "", BLANK)
        .when(seen > 1, DUPLICATE)
        .when(last.isin(".", "!", "?"), NONE)
        .otherwise(TRUNCATED)
    )
    return dealt.withColumns({"fault": fault.cast("tinyint"), "letter": F.left("role", F.lit(1))})


def _values(column: pd.Series) -> list:
    """The values of a text column, None where there is none."""
    return column.astype(object).where(column.notna(), None).tolist()


def _add_moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Backpointers of rows that come in from each conversation's last message back."""
    steps = Steps()
    current, costs = object(), Steps.LAST
    for batch in batches:
        moves = np.zeros(len(batch), np.int16)
        for n, (conv, letter, fault) in enumerate(
            zip(_values(batch["conv"]), _values(batch["letter"]), batch["fault"])
        ):
            if conv != current:
                current, costs = conv, Steps.LAST
            if letter is not None:
                costs, moves[n] = steps.step(costs, letter, fault)
        yield batch.assign(moves=moves)


class Walk:
    """Follows the backpointers through one conversation."""

    def __init__(self, conv: object):
        self.conv, self.state, self.cost = conv, _START, 0
        self.edits = bytearray()
        self.illegal, self.last_letter = 0, None
        self.faults = [0, 0, 0, 0]
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.sha, self.out = hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> tuple[int, str, str]:
        self.sha.update((f"\n{role}:{text}" if self.out else f"{role}:{text}").encode())
        self.out += 1
        return self.out - 1, role, text

    def _insert(self) -> tuple[int, str, str]:
        put = self._put(_ROLE[self.state], "")
        self.state = _NEXT[self.state]
        self.cost += INSERT
        self.edits.append(ord("I"))
        return put

    def message(self, turn: object, role: str, text: str, letter: str, fault: int, moves: int) -> list[tuple]:
        """The repaired messages that a message leads to."""
        if turn is not None:
            if self.turns == 0 or turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.faults[fault] += 1
        self.illegal += self.last_letter is not None and self.last_letter + letter not in ("su", "ua", "au")
        self.last_letter = letter
        made = []
        while (edit := moves >> (2 * self.state) & 3) == _I:
            made.append(self._insert())
        self.edits.append(ord(LETTERS[edit]))
        if edit == _D:
            self.cost += DELETE
            return made
        self.cost += (KEEP if edit == _K else REROLE) + (CUT_SHORT if fault == TRUNCATED else 0)
        if edit == _K:
            made.append(self._put(role, text))
            self.state = kept_state(self.state, letter)
        else:
            made.append(self._put(_ROLE[self.state], text))
            self.state = _NEXT[self.state]
        return made

    def end(self) -> list[tuple]:
        made = []
        while self.state not in _ENDS:
            made.append(self._insert())
        return made

    def audit(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (
            self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
            self.cost, self.edits.decode(), self.sha.hexdigest(),
        )


AUDIT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
REPAIRED = "place long, role string, text string"


def _walked(batches: Iterator[pd.DataFrame], audits: bool, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Audits, or repaired messages, of rows that come in by turn."""
    walk = None

    def ended(walk: Walk) -> list[tuple]:
        rest = walk.end()
        return [walk.audit()] if audits else [(walk.conv, *m) for m in rest]

    for batch in batches:
        out = []
        texts = (_values(batch[name]) for name in ("conv", "role", "text", "letter"))
        for conv, role, text, letter, turn, has_turn, fault, moves in zip(
            *texts, batch["turn"].tolist(), batch["has_turn"], batch["fault"], batch["moves"].tolist()
        ):
            if walk is None or conv != walk.conv:
                out += ended(walk) if walk else []
                walk = Walk(conv)
            if role is not None:
                made = walk.message(turn if has_turn else None, role, text, letter, fault, moves)
                if not audits:
                    out += [(conv, *m) for m in made]
        yield pd.DataFrame(out, columns=columns, dtype=object)
    if walk is not None:
        yield pd.DataFrame(ended(walk), columns=columns, dtype=object)


def _walk(rows: DataFrame, audits: bool) -> DataFrame:
    """Both walks over ``rows(conv, turn, role, text)``, after one shuffle."""
    # Numbers without nulls, as pandas would turn the others into floats.
    kept = judged(rows).select(
        "conv", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", "text", "letter", "fault",
    )
    order = ["conv", "has_turn", "turn", "role", "text", "fault"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    marked = kept.sortWithinPartitions(*(F.desc(c) for c in order)).mapInPandas(
        _add_moves, f"{schema}, moves short"
    )
    made = AUDIT if audits else REPAIRED
    columns = ["conv", *(part.split()[0] for part in made.split(", "))]
    return marked.sortWithinPartitions(*order).mapInPandas(
        lambda batches: _walked(batches, audits, columns), f"conv string, {made}"
    )


def _with_id(result: DataFrame, df: DataFrame, conversation: str) -> DataFrame:
    """Ids in the type and under the name that they came with."""
    own = F.col("conv").cast(df.schema[conversation].dataType).alias(conversation)
    return result.select(own, *result.columns[1:])


def audit_conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: its id, the counts of gaps and faults, the pairs of
    neighbours with illegal roles, the cheapest cost, its edits, and the SHA-256
    of the repaired messages."""
    return _with_id(_walk(messages(df, conversation, turn, role, text), True), df, conversation)


def repair_conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired messages: id, ``place`` from 0, ``role``, ``text``. A
    conversation of which nothing is left has no rows."""
    return _with_id(_walk(messages(df, conversation, turn, role, text), False), df, conversation)


def damaged(df: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of ``conversations`` damaged by the hash of id and turn.

    Of 20 messages one is dropped, one emptied, one loses its ends of sentences,
    one is repeated and one becomes the user's. A dropped message leaves a row
    with null role and text, so that its conversation is not forgotten.
    """
    place = F.concat(
        _null_space(F.col("conv_id").cast("string")), F.lit(":"), _null_space(F.col("turn").cast("string"))
    )
    code = F.crc32(place.cast("binary")) % 20
    rows = messages(df, "conv_id", "turn", "role", "text", code)
    present = F.col("code") != 0
    text = (
        F.when(F.col("code") == 1, "")
        .when(F.col("code") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select(
        "conv", "turn", F.when(present, role).alias("role"), F.when(present, text).alias("text"), copies.alias("_copy")
    ).drop("_copy")


def audit_damaged(df: DataFrame) -> DataFrame:
    """The audits of ``conversations`` after ``damaged``, one row per original id."""
    return _with_id(_walk(damaged(df), True), df, "conv_id")
