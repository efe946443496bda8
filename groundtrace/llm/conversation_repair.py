"""Repair of conversations into an optional system turn and pairs of user and assistant turns, at least cost.

A conversation's rows in turn order are edited until the initials of its roles read ``(s?(ua)+)?``: Keep costs 0, Rerole
to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated row that is not deleted adds
1, blank and duplicate rows must be deleted. Of the cheapest edits those whose initials come first in ASCII order win.

``search`` is a depth-first branch and bound with its own stack. A node is the number of rows read and the state of the
pattern. Children are tried in the order of cost plus a bound of the cheapest way through the rows that remain, which
leaves out where a system turn may stand. A node ends where that sum is above the incumbent, or equal and its edits
come later, or where the node was reached before at no higher (cost, edits). The last rule loses nothing: two ways to a
node at one cost are never the beginning of one another, as the longer one would hold more inserts. What is left on the
stack is empty only when the incumbent is proved.

Conversations stream through tasks sorted by turn. One of many rows is searched in blocks: from the best edits to each
state at its begin to those at its end, with the digest of the repaired text so far carried along, so a task holds a
block of rows, not a conversation. The edits themselves are one letter per row and belong to the result. SHA-256 reads a
conversation in order; that is why one conversation is one task's work however long it is.

Defined cases: null roles and texts count as one space. Rows of one turn are ordered by role, text; a null turn comes
first and counts for no gap. A role that is empty, or begins otherwise than with s, u or a, fits nowhere. Null
conversation ids are one conversation. Further columns may bear any name. An empty table gives no rows; a conversation
without present rows gives zeros, no edits and the digest of the empty text.
"""

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtrace.llm.tables import arrow_batches

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = frozenset((START, ASSISTANT))
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
BLOCK_ROWS, BLOCK_BYTES = 64, 4 << 20

# States after an output of the given initial, and the states from which a state can be reached.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
REACHING = {START: {START}, SYSTEM: {START, SYSTEM}, USER: {0, 1, 2, 3}, ASSISTANT: {0, 1, 2, 3}}
NEXT_ROLE = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    deleted: bool  # blank or duplicate
    truncated: bool


def suffix_bounds(rows: list[Row], exits: frozenset[int]) -> list[tuple[int, int]]:
    """Least cost from each row on, where a user (0) or an assistant (1) comes next; a system row may stand anywhere."""
    ends = {int(state == USER) for state in exits}
    after = tuple(0 if c in ends else INSERT for c in (0, 1))
    bounds = [after]
    for row in reversed(rows):
        cut = CUT * row.truncated
        base = []
        for c in (0, 1):
            ways = [DELETE + after[c]]
            if not row.deleted:
                ways.append(REROLE + cut + after[1 - c])
                if row.role[:1] == "ua"[c]:
                    ways.append(cut + after[1 - c])
                elif row.role[:1] == "s" and c == 0:
                    ways.append(cut + after[0])
            base.append(min(ways))
        after = tuple(min(base[c], INSERT + base[1 - c]) for c in (0, 1))
        bounds.append(after)
    return bounds[::-1]


def search(rows: list[Row], entries: dict[int, tuple[int, str]], exits: frozenset[int]
           ) -> tuple[int, str, int, int] | None:
    """(cost, edits, state, entry) of the cheapest way, ASCII-least of these, from an entry to one of the exits.

    ``entries`` holds cost and edits so far by state; the edits returned begin with those of their entry.
    """
    bounds, reaching = suffix_bounds(rows, exits), set().union(*(REACHING[e] for e in exits))
    best: tuple[int, str, int, int] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = sorted(((cost + bounds[0][state == USER], edits, 0, state, cost, state)
                    for state, (cost, edits) in entries.items() if state in reaching), reverse=True)
    while stack:
        least, edits, at, state, cost, entry = stack.pop()
        if best and (least > best[0] or least == best[0] and edits > best[1][:len(edits)]):
            continue
        if seen.get((at, state), (cost + 1, "")) <= (cost, edits):
            continue
        seen[at, state] = (cost, edits)
        if at == len(rows) and state in exits and (best is None or (cost, edits) < best[:2]):
            best = (cost, edits, state, entry)
        steps = [(INSERT, "I", at, USER if state != USER else ASSISTANT)]
        if at < len(rows):
            row = rows[at]
            steps.append((DELETE, "D", at + 1, state))
            if not row.deleted:
                cut = CUT * row.truncated
                steps.append((REROLE + cut, "R", at + 1, USER if state != USER else ASSISTANT))
                kept = AFTER.get((state, row.role[:1]))
                if kept is not None:
                    steps.append((cut, "K", at + 1, kept))
        children = [(cost + price + bounds[to][after == USER], edits + letter, to, after, cost + price, entry)
                    for price, letter, to, after in steps if after in reaching]
        stack += sorted(children, reverse=True)
    return best


@dataclass
class Prefix:
    """The best edits to one state: those behind the common ones, and the repaired text so far as a running digest."""

    cost: int
    edits: str
    digest: object
    outputs: int

    def extended(self, rows: list[Row], cost: int, edits: str, state: int, letters: str) -> "Prefix":
        out = Prefix(cost, edits, self.digest.copy(), self.outputs)
        left = iter(rows)
        for letter in letters:
            row = Row("", "", False, False) if letter == "I" else next(left)
            if letter == "D":
                continue
            role = row.role if letter == "K" else NEXT_ROLE[state]
            state = AFTER[state, role[:1]]
            out.digest.update((("\n" if out.outputs else "") + f"{role}:{row.text}").encode("utf-8", "surrogatepass"))
            out.outputs += 1
        return out


@dataclass
class Conversation:
    """One conversation while its rows pass."""

    common: list[str] = field(default_factory=list)  # edits that all prefixes share
    prefixes: dict[int, Prefix] = field(default_factory=lambda: {START: Prefix(0, "", hashlib.sha256(), 0)})
    block: list[Row] = field(default_factory=list)
    held: int = 0

    def add(self, row: Row) -> None:
        self.block.append(row)
        self.held += len(row.text)
        if len(self.block) >= BLOCK_ROWS or self.held >= BLOCK_BYTES:
            self._advance([frozenset((q,)) for q in range(4)])

    def _advance(self, ends: list[frozenset[int]]) -> None:
        entries = {q: (p.cost, p.edits) for q, p in self.prefixes.items()}
        found = {}
        for exits in ends:
            way = search(self.block, entries, exits)
            if way:
                cost, edits, state, entry = way
                start = self.prefixes[entry]
                found[state] = start.extended(self.block, cost, edits, entry, edits[len(start.edits):])
        shared = os.path.commonprefix([p.edits for p in found.values()])
        self.common.append(shared)
        for p in found.values():
            p.edits = p.edits[len(shared):]
        self.prefixes, self.block, self.held = found, [], 0

    def finish(self) -> tuple[int, str, str]:
        """(cost, edits, digest)."""
        self._advance([FINAL])
        (last,) = self.prefixes.values()
        return last.cost, "".join(self.common) + last.edits, last.digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows with their faults, of each conversation together and in order."""
    there = F.col(present) if present else F.lit(True)
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.coalesce(there, F.lit(False)).alias("there"))
    rows = rows.withColumn("end", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    fault = F.when(F.col("end") == "", "blank").when(F.col("seen") > 1, "duplicate").when(
        ~F.col("end").isin(".", "!", "?"), "truncated")
    seen = F.row_number().over(Window.partitionBy("conv", "there", "role", "text").orderBy("turn"))
    return rows.repartition("conv").withColumn("seen", seen).withColumn("fault", fault)


ORDER = ("there", "turn", "role", "text", "seen")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, edits, digest), one row per conversation.

    ``present`` names a boolean column: rows without it only say that their conversation exists. ``digest`` is the
    SHA-256 of the repaired turns ``role:text`` joined by line feeds; ``repaired_turns`` gives the turns themselves.
    """
    arrow_batches(turns.sparkSession)
    rows = _prepared(turns, conv, turn, role, text, present)
    kind = rows.schema["conv"].dataType
    ordered = rows.select("conv", *ORDER, "fault").sortWithinPartitions("conv", *ORDER)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, now, done, convs = None, None, None, [], None

        def close():
            cost, edits, digest = current.finish()
            now["cost"] = cost
            now["gaps"] = now.pop("last") - now.pop("first") + 1 - now.pop("turns") if now["turns"] else 0
            done.append((own, [now[c] for c in COUNTS], edits, digest))

        def packed():
            return pa.record_batch(
                [pa.array([d[0] for d in done], convs), *[pa.array([d[1][i] for d in done], pa.int64()) for i in range(len(COUNTS))],
                 pa.array([d[2] for d in done], pa.string()), pa.array([d[3] for d in done], pa.string())],
                names=["conv", *COUNTS, "edits", "digest"])

        for batch in batches:
            convs = batch.schema.field("conv").type
            columns = [c.to_pylist() for c in batch.columns]
            for name, there, number, who, said, _, fault in zip(*columns):
                if current is None or name != own:
                    if current is not None:
                        close()
                    current, own = Conversation(), name
                    now = dict.fromkeys(COUNTS, 0) | {"first": None, "last": None, "turns": 0, "role": None}
                if not there:
                    continue
                if number is not None and number != now["last"]:
                    now["first"] = number if now["first"] is None else now["first"]
                    now["last"], now["turns"] = number, now["turns"] + 1
                if now["role"] is not None and now["role"] + who[:1] not in LEGAL:
                    now["illegal"] += 1
                now["role"] = who[:1]
                if fault:
                    now[fault] += 1
                current.add(Row(who, said, fault in ("blank", "duplicate"), fault == "truncated"))
            if len(done) >= 1000:
                yield packed()
                done = []
        if current is not None:
            close()
            yield packed()

    shape = f"conv {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", edits string, digest string"
    return ordered.mapInArrow(stream, shape)


def repaired_turns(turns: DataFrame, repaired: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text", present: str | None = None) -> DataFrame:
    """(conv, place, edit, role, text): the turns that ``repair`` leaves, numbered from 1 in each conversation."""
    rows = _prepared(turns, conv, turn, role, text, present).filter("there")
    numbered = rows.withColumn("no", F.row_number().over(Window.partitionBy("conv").orderBy(*ORDER)))
    letters = repaired.select(F.col("conv").alias("of"), F.length(F.translate("edits", "D", "")).alias("size"),
                              F.posexplode(F.split("edits", "")).alias("at", "edit")).filter("edit <> ''")
    so_far = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("long")).over(so_far)

    placed = letters.select("of", "edit", "size", count(F.col("edit") != "I").alias("row"), count(F.col("edit") != "D").alias("place"))
    joined = placed.filter("edit <> 'D'").join(
        numbered, F.col("of").eqNullSafe(F.col("conv")) & (F.col("row") == F.col("no")) & (F.col("edit") != "I"), "left")
    given = F.when((F.col("place") - F.col("size") % 2) % 2 == 1, "user").otherwise("assistant")
    return joined.select(F.col("of").alias("conv"), "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
