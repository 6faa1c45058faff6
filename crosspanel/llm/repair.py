"""Least-cost repair of the structure of conversations by branch and bound.

The roles of a repaired conversation read ``(system? (user assistant)+)?``.  Edits work through the
rows in order: keep (0), give the role user or assistant (3), delete (4; blank and repeated
rows must go), insert an empty row of role user or assistant (3); a truncated row that stays costs 3
more.  The cheapest edit script is wanted, and the first in ASCII order among equals.

The search is depth first with an explicit stack of open prefixes, a node being (rows done, last
role).  A bound for every suffix, made backwards from the end, tells what a node costs to
complete at least; children are tried by bound and then by edit.  A prefix is dropped if its
bound exceeds the incumbent's cost, if it ties and its audit comes later, or if its node was
reached with a cost as low and an earlier audit.  The search ends when the stack is empty, which
proves the incumbent.

A task sees its conversations one after the other, each one twice: first one small row a turn for the
faults and the search, then the texts, which are passed on and not held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crosspanel.llm.frames import map_batches
from crosspanel.llm.shards import CRC_TABLE, sql_crc32
from crosspanel.llm.textbytes import text_slices

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: Last role of a prefix; the next role that an edit may give, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
DONE = (START, ASSISTANT)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_LEGAL = {"su", "ua", "au"}


def moves(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a row as (edit, cost, rows used, next state)."""
    yield DELETE, DELETE_COST, 1, state
    yield INSERT, INSERT_COST, 0, NEXT[state]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        own = INITIAL.get(initial)
        if own is not None and (own == NEXT[state] or own == SYSTEM and state == START):
            yield KEEP, KEEP_COST + more, 1, own
        yield REROLE, REROLE_COST + more, 1, NEXT[state]


def suffix_bounds(initials: list[str], faults: list[int]) -> list[list[int]]:
    """Least cost of every suffix from every state, the audit aside."""
    bounds = [[0, 2 * INSERT_COST, INSERT_COST, 0]]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after = bounds[-1]
        now = [min(cost + after[to] for _, cost, used, to in moves(state, initial, fault) if used) for state in range(4)]
        now[USER], now[ASSISTANT] = min(now[USER], now[ASSISTANT] + INSERT_COST), min(now[ASSISTANT], now[USER] + INSERT_COST)
        for state in (START, SYSTEM):
            now[state] = min(now[state], now[USER] + INSERT_COST)
        bounds.append(now)
    return bounds[::-1]


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """Cost and audit of the best edit script."""
    n, bounds = len(initials), suffix_bounds(initials, faults)
    best_cost, best = None, ""
    reached: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    path: list[str] = []
    against = [0]  # path up to a depth compared with the incumbent: -1 earlier, 0 alike, 1 later
    stack: list[tuple[int, int, int, int, tuple | None]] = [(0, START, 0, 0, None)]
    while stack:
        i, state, cost, depth, trail = stack.pop()
        if depth:
            del path[depth - 1 :], against[depth:]
            edit = trail[1]
            path.append(edit)
            beyond = edit > best[depth - 1] if depth <= len(best) else True
            same = depth <= len(best) and edit == best[depth - 1]
            against.append(against[-1] or (0 if same else 1 if beyond else -1))
        bound = cost + bounds[i][state]
        if best_cost is not None and (bound > best_cost or bound == best_cost and against[depth] > 0):
            continue
        known = reached.get((i, state))
        if known is not None and (known[0] < cost or known[0] == cost and _spelled(known[1]) <= _spelled(trail)):
            continue
        reached[i, state] = cost, trail
        if i == n and state in DONE:
            if best_cost is None or (cost, "".join(path)) < (best_cost, best):
                best_cost, best = cost, "".join(path)
                against = [0] * (depth + 1)
            continue
        options = moves(state, initials[i], faults[i]) if i < n else [(INSERT, INSERT_COST, 0, NEXT[state])]
        children = sorted((price + bounds[i + used][to], edit, i + used, to, cost + price) for edit, price, used, to in options)
        stack.extend((j, to, paid, depth + 1, (trail, edit)) for _, edit, j, to, paid in reversed(children))
    return best_cost or 0, best


def _spelled(trail: tuple | None) -> str:
    out = []
    while trail is not None:
        trail, edit = trail
        out.append(edit)
    return "".join(reversed(out))


@dataclass
class _Conversation:
    """Faults and edits of the conversation that a task is at."""

    conv_id: int
    initials: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    seen: set[tuple[str, str]] = field(default_factory=set)
    turns: list[int] = field(default_factory=lambda: [0, 0, 0])  # least, largest, distinct
    illegal: int = 0
    audit: str | None = None
    cost: int = 0
    at: int = 0
    state: int = START
    place: int = 0

    def add(self, turn: int | None, role: str, text_hash: str, blank: bool, truncated: bool) -> None:
        initial, content = role[:1], (role, text_hash)
        fault = BLANK if blank else DUPLICATE if content in self.seen else TRUNCATED if truncated else FINE
        self.seen.add(content)
        if self.initials and self.initials[-1] + initial not in _LEGAL:
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None and (not self.turns[2] or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns[2] else turn, turn, self.turns[2] + 1]

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(self.initials, self.faults)
            self.seen.clear()

    def edits(self, role: str | None, text: str | None) -> Iterator[tuple[str, str | None, str | None]]:
        """The edits up to the next row, or at the end: (edit, role, text), role null if it goes."""
        while self.at < len(self.audit):
            edit = self.audit[self.at]
            if edit != INSERT and role is None:
                return
            self.at += 1
            if edit == INSERT:
                self.state = NEXT[self.state]
                yield edit, ROLE[self.state], ""
                continue
            if edit == DELETE:
                yield edit, None, None
            elif edit == KEEP:
                self.state = INITIAL[role[:1]]
                yield edit, role, text
            else:
                self.state = NEXT[self.state]
                yield edit, ROLE[self.state], text
            return

    def summary(self) -> tuple:
        least, most, distinct = self.turns
        count = [self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return self.conv_id, most - least + 1 - distinct if distinct else 0, *count, self.illegal, self.cost, self.audit


def _rows_in_order(conversations: DataFrame) -> DataFrame:
    """Every row twice, without its text for the search and with it for the repair, in order."""
    spaces = r"\x20\x09-\x0D"
    text = F.col("text")
    rows = conversations.select(
        "conv_id", "turn", "role", "text", F.md5(text.cast("binary")).alias("text_hash"), "gone",
        (~text.rlike(f"[^{spaces}]")).alias("blank"), (~text.rlike(rf"[.!?][{spaces}]*\z")).alias("truncated"),
        F.explode(F.when(F.col("gone"), F.array(F.lit(0))).when(F.col("twice"), F.array(*map(F.lit, (0, 0, 1, 1)))).otherwise(F.array(*map(F.lit, (0, 1))))).alias("pass"),
    )
    rows = rows.withColumn("text", F.when(F.col("pass") == 1, text))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pass", "turn", "role", "text_hash")


_FIELDS = ("conv_id", "pass", "turn", "role", "text_hash", "gone", "blank", "truncated", "text")


class _Edited:
    """Collects the edited rows of a batch."""

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    schema = StructType([StructField("conv_id", LongType()), StructField("place", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def begin(self) -> None:
        pass

    def write(self, conversation: _Conversation, edit: str, role: str | None, text: str | None) -> None:
        self.rows.append((conversation.conv_id, None if role is None else conversation.place, edit, role, text))

    def end(self, conversation: _Conversation) -> None:
        pass

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, self.kinds, strict=True)], self.schema.names)
            self.rows.clear()


class _Digests(_Edited):
    """Collects a row for each conversation, its repaired rows going into a digest."""

    kinds = (*[pa.int64()] * 7, pa.string(), pa.string())
    schema = StructType([StructField(n, LongType()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")])

    def begin(self) -> None:
        self.sha = hashlib.sha256()

    def write(self, conversation: _Conversation, edit: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.sha.update((("\n" if conversation.place else "") + role + ":" + text).encode())

    def end(self, conversation: _Conversation) -> None:
        self.rows.append((*conversation.summary(), self.sha.hexdigest()))


def _walk(batches: Iterator[pa.RecordBatch], sink: _Edited) -> Iterator[pa.RecordBatch]:
    """Search and repair each conversation of a sorted stream."""
    now: _Conversation | None = None

    def repaired(role: str | None, text: str | None) -> None:
        now.solve()
        for edit, new_role, new_text in now.edits(role, text):
            sink.write(now, edit, new_role, new_text)
            now.place += new_role is not None

    for part in text_slices(batches, "text"):
        for conv_id, step, turn, role, text_hash, gone, blank, truncated, text in zip(*(part.column(f).to_pylist() for f in _FIELDS), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    repaired(None, None)
                    sink.end(now)
                now = _Conversation(conv_id)
                sink.begin()
            if not gone and step == 0:
                now.add(turn, role, text_hash, blank, truncated)
            elif not gone:
                repaired(role, text)
        yield from sink.flush()
    if now is not None:
        repaired(None, None)
        sink.end(now)
    yield from sink.flush()


def _prepared(conversations: DataFrame) -> DataFrame:
    have = conversations.columns
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    flag = lambda c: F.col(c) if c in have else F.lit(False).alias(c)
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), flag("gone"), flag("twice"))


def repair_rows(conversations: DataFrame) -> DataFrame:
    """The edited conversations: conv_id, place (from 0, null if deleted), edit, role and text.

    Rows are taken by turn (nulls first), ties by role and then by a hash of the text.  A null role
    or text is one space; a role whose initial isn't s, u or a can't stay.  Rows without a conv_id belong to
    no conversation.  Other columns are ignored.  An empty table gives no rows.
    """
    return map_batches(_rows_in_order(_prepared(conversations)), lambda batches: _walk(batches, _Edited()), _Edited.schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and audit of the repair and a digest of its result.

    Rows marked ``gone`` count as deleted beforehand, so that a conversation without any other row is reported
    with zeros; those marked ``twice`` occur twice.  Otherwise as in ``repair_rows``.
    """
    return map_batches(_rows_in_order(_prepared(conversations)), lambda batches: _walk(batches, _Digests()), _Digests.schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with every fifth row or so spoilt, by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), (kind == 3).alias("twice"))


def _sql_moves() -> str:
    """Edits as rows (state, next state, what they need, used rows, edit, cost)."""
    rows = []
    for state in range(4):
        for initial in ("s", "u", "a"):
            rows += [(state, to, initial, edit, cost) for edit, cost, used, to in moves(state, initial, FINE) if edit == KEEP]
        rows += [(state, to, "", edit, cost) for edit, cost, used, to in moves(state, "", FINE)]
    return ", ".join(f"({a}, {b}, '{c}', '{d}', {e})" for a, b, c, d, e in rows)


#: Every state's cheapest script so far, row by row; inserts are tried twice before each row and at the end.
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_table WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, role[1:1] AS first FROM d),
f AS (SELECT *, lag(first) OVER (PARTITION BY conv_id ORDER BY i) || first AS two, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM r),
m(s, t, needs, edit, price) AS (VALUES {_sql_moves()}),
c AS (SELECT conv_id, list(first ORDER BY i) AS firsts, list(fault ORDER BY i) AS faults, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts,
  max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
w(conv_id, phase, s, cost, audit, lines) AS (
  SELECT conv_id, 0, {START}, 0, '', []::VARCHAR[] FROM c
  UNION ALL
  SELECT conv_id, phase, t, (b).cost, (b).audit, (b).lines FROM (
    SELECT conv_id, phase, t, min(struct_pack(cost, audit, lines)) AS b FROM (
      SELECT w.conv_id, w.phase + 1 AS phase, w.s AS t, w.cost, w.audit, w.lines FROM w JOIN c USING (conv_id) WHERE w.phase % 3 < 2 AND w.phase < 3 * len(firsts) + 2
      UNION ALL
      SELECT w.conv_id, w.phase + 1, t, w.cost + price, w.audit || edit, list_append(w.lines, CASE t WHEN {USER} THEN 'user:' ELSE 'assistant:' END)
        FROM w JOIN c USING (conv_id) JOIN m ON m.s = w.s AND edit = 'I' WHERE w.phase % 3 < 2 AND w.phase < 3 * len(firsts) + 2
      UNION ALL
      SELECT w.conv_id, w.phase + 1, t, w.cost + price + CASE WHEN edit <> 'D' AND faults[w.phase // 3 + 1] = 't' THEN 3 ELSE 0 END, w.audit || edit,
        CASE edit WHEN 'D' THEN w.lines WHEN 'K' THEN list_append(w.lines, roles[w.phase // 3 + 1] || ':' || texts[w.phase // 3 + 1]) ELSE list_append(w.lines, CASE t WHEN {USER} THEN 'user:' ELSE 'assistant:' END || texts[w.phase // 3 + 1]) END
        FROM w JOIN c USING (conv_id) JOIN m ON m.s = w.s AND (edit = 'D' OR faults[w.phase // 3 + 1] NOT IN ('b', 'd') AND (edit = 'R' OR edit = 'K' AND needs = firsts[w.phase // 3 + 1]))
        WHERE w.phase % 3 = 2 AND w.phase < 3 * len(firsts)
    ) GROUP BY 1, 2, 3)),
e AS (SELECT w.conv_id, min(struct_pack(cost, audit, lines)) AS b FROM w JOIN c USING (conv_id) WHERE phase = 3 * len(firsts) + 2 AND s IN ({START}, {ASSISTANT}) GROUP BY 1)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((b).cost, 0)::BIGINT AS cost, coalesce((b).audit, '') AS audit, sha256(coalesce(array_to_string((b).lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM k) k LEFT JOIN c USING (conv_id) LEFT JOIN e USING (conv_id)
"""
