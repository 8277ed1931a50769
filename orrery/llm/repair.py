r"""Repair of conversations whose turns are lost, empty, repeated or cut off.

Roles must read (s?(ua)+)? by their initials. A row may be kept, get another role or be deleted, and turns
without text may be put in anywhere; each edit has a cost. Over (row, state of the grammar) the cost to go is
found from the last row backwards; a walk from the first row forwards then takes, of the edits that keep to
the least cost, the one whose letter is least in ASCII, and gives the repaired turns as it goes. In each state
of the grammar only one role can be given, so the edits' letters tell the repair.

A conversation is read in chunks of CHUNK rows. For one of several chunks each gives a matrix, the least cost
from any state before it to any after it, found chunk by chunk across the cluster; these matrices give every
chunk's costs at its end, so the walk needs one chunk's rows at a time. The digest of a conversation's turns
is of one text, which is why its rows go by one task in order, a chunk at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, in_order, numbered, small_or_not

#: Rows of a conversation that the walk holds at a time.
CHUNK = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a. What an initial leads to, and the role that may be given.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: The cost to go from each state after the last row: turns are put in until the grammar is content.
END = (0, 2 * INSERT, INSERT, 0)

_SPACE = r"\x20\x09-\x0D"
Costs = tuple[float, float, float, float]
#: A row to the costs: whether it must go, whether it is cut off, its role's initial.
Kind = tuple[bool, bool, str]


def before(kind: Kind, then: Costs) -> Costs:
    """The costs to go before a row from those after it."""
    must, cut_off, initial = kind
    more = TRUNCATED * cut_off
    own = []
    for state in range(4):
        cost = DELETE + then[state]
        if not must:
            cost = min(cost, REROLE + more + then[GIVEN[state][1]])
            if initial in AFTER[state]:
                cost = min(cost, more + then[AFTER[state][initial]])
        own.append(cost)
    user, assistant = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + user), min(own[1], INSERT + user), user, assistant


def costs_to_go(kinds: list[Kind], end: Costs) -> list[Costs]:
    """The costs before each row, and end."""
    found = [end]
    for kind in reversed(kinds):
        found.append(before(kind, found[-1]))
    found.reverse()
    return found


def matrix(kinds: list[Kind]) -> list[float]:
    """The least cost from each state before the rows to each state after them, row by row; infinite where none leads."""
    columns = [costs_to_go(kinds, tuple(0.0 if s == t else math.inf for s in range(4)))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(kinds: list[Kind], costs: list[Costs], state: int, last: bool) -> Iterator[tuple[str, int, str | None, int]]:
    """(letter, row, role given or None, state after it) of the edits, the row being the next one where a turn is put in."""
    row, n = 0, len(kinds)
    while row < n or last and costs[n][state]:
        now = costs[row][state]
        role, to = GIVEN[state]
        if row < n and DELETE + costs[row + 1][state] == now:
            yield "D", row, None, state
            row += 1
            continue
        if (put := INSERT + costs[row][to]) == now:
            letter, given = "I", role
        else:
            _, cut_off, initial = kinds[row]
            kept = AFTER[state].get(initial)
            if kept is not None and TRUNCATED * cut_off + costs[row + 1][kept] == now:
                letter, given, to = "K", None, kept
            else:
                letter, given = "R", role
        state = to
        yield letter, row, given, state
        row += put != now


# --- tables ---


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with faults by crc32 of "conv_id:turn" modulo 20; nulls in the key, role and text count as one space.

    0 drops the row, 1 empties its text, 2 takes every . ! ? out of it, 3 gives the row twice, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("kind <> 0").withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE}]")


def cut_off(text: Column) -> Column:
    """Whether the last character that isn't white space is other than . ! ?"""
    return ~text.rlike(f"[.!?][{_SPACE}]*\\z")


def _ends(placed: DataFrame, firsts: DataFrame, chunk: int) -> DataFrame:
    """conv_id and ends, the costs after each chunk, for conversations of more than one chunk.

    Matrices of one conversation meet in one task, 16 numbers for chunk rows.
    """
    large = placed.groupBy("conv_id").count().where(F.col("count") > chunk).select(F.col("conv_id").alias("large"))
    rows = numbered(placed, "conv_id").join(small_or_not(large), F.col("conv_id").eqNullSafe(F.col("large")), "left_semi")
    rows = rows.join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    rows = rows.select("conv_id", F.expr(f"pos div {chunk}").alias("chunk"), "pos", "must", "cut_off", "initial", "first")

    def matrices(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        kinds = [(must or not first, cut, i) for must, first, cut, i in zip(*(table.column(c).to_pylist() for c in ("must", "first", "cut_off", "initial")), strict=True)]
        return pa.table([table.column("conv_id")[:1], table.column("chunk")[:1], pa.array([matrix(kinds)], pa.list_(pa.float64()))], ["conv_id", "chunk", "m"])

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        told: list[Costs] = [END]
        for m in reversed(table.column("m").to_pylist()[1:]):
            told.append(tuple(min(m[4 * s + t] + told[-1][t] for t in range(4)) for s in range(4)))
        return pa.table([table.column("conv_id")[:1], pa.array([[x for costs in reversed(told) for x in costs]], pa.list_(pa.float64()))], ["conv_id", "ends"])

    of = rows.groupBy("conv_id", "chunk").applyInArrow(matrices, "conv_id long, chunk long, m array<double>")
    return of.groupBy("conv_id").applyInArrow(ends, "conv_id long, ends array<double>")


@dataclass
class _Conversation:
    """What is told of a conversation while its rows go by."""

    conv_id: int | None
    ends: list[float] | None = None
    chunk: int = 0
    state: int = 0
    rows: list[tuple] = field(default_factory=list)
    turns: int = 0
    low: int | None = None
    high: int | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    initial: str | None = None
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    began: bool = False
    place: int = 0

    def count(self, turn: int | None, role: str, is_blank: bool, is_cut_off: bool, first: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += is_blank
        self.duplicate += not is_blank and not first
        self.truncated += not is_blank and first and is_cut_off
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def step(self, last: bool) -> Iterator[tuple]:
        """Repair the rows at hand: (edit, turn, role, text) of each edit; deleted rows come with their own."""
        kinds = [(is_blank or not first, is_cut_off, role[:1]) for _, role, _, is_blank, is_cut_off, first in self.rows]
        end = END if last else tuple(self.ends[4 * self.chunk : 4 * self.chunk + 4])
        for letter, row, given, state in walk(kinds, costs_to_go(kinds, end), self.state, last):
            self.state = state
            turn, role, text, _, is_cut_off, _ = self.rows[row] if letter != "I" else (None, given, "", False, False, True)
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter] + (letter in "KR" and is_cut_off) * TRUNCATED
            self.audit.append(letter)
            role = given or role
            if letter != "D":
                self.sha.update(("\n" * self.began + f"{role}:{text}").encode())
                self.began = True
            yield letter, turn, role, text
        self.rows, self.chunk = [], self.chunk + 1

    def told(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def _read(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[_Conversation, list[tuple], bool]]:
    """The conversation, edits of one chunk of it, and whether it ends, out of rows sorted by conversation, place and kind."""
    now, first = None, False
    names = ("conv_id", "kind", "turn", "role", "text", "must", "cut_off", "ends")
    for batch in batches:
        for conv, kind, turn, role, text, is_blank, is_cut_off, ends in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield now, list(now.step(True)), True
                now = _Conversation(conv)
            if kind == 0:
                now.ends = ends
            elif kind == 1:  # the next row is the first with its role and text
                first = True
            else:
                if len(now.rows) == chunk:
                    yield now, list(now.step(False)), False
                now.count(turn, role, is_blank, is_cut_off, first)
                now.rows.append((turn, role, text, is_blank, is_cut_off, first))
                first = False
    if now is not None:
        yield now, list(now.step(True)), True


def _reports(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    names, rows = [f.split(" ")[0] for f in REPORT.split(", ")], []
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    for now, _, ends in _read(batches, chunk):
        if ends:
            rows.append(now.told())
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _turns(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    names, kinds = [f.split(" ")[0] for f in TURNS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for now, edits, _ in _read(batches, chunk):
        if edits:
            rows = [(now.conv_id, now.place + k, *e) for k, e in enumerate(edits)]
            now.place += len(edits)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _stream(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows by conversation and order, each first of its role and text after a mark, and before all the ends of a long conversation's chunks."""
    bounded_batches(rows.sparkSession)
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    placed = in_order(rows, ["conv_id", "turn", "role", "text"])
    told = placed.withColumns({"must": blank(F.col("text")), "cut_off": cut_off(F.col("text")), "initial": F.substring("role", 1, 1)})
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy("conv_id", same.alias("same")).agg(F.min("place").alias("place")).select("conv_id", "place")
    ends = _ends(told.select("conv_id", "place", "must", "cut_off", "initial"), firsts, chunk)
    marks = firsts.withColumn("kind", F.lit(1)).unionByName(ends.withColumns({"kind": F.lit(0), "place": F.lit(-1).cast("long")}), allowMissingColumns=True)
    both = told.drop("initial").withColumn("kind", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")


def repaired_turns(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cheapest repair of rows(conv_id, turn, role, text), an edit a row: conv_id, place, edit, turn, role and text.

    edit is K (kept), R (another role), I (put in, without turn and text) or D (deleted; the row as it was, no
    part of the repair). Rows of a conversation are in the order of turn (null first), role and text; a null
    role or text is one space, a null conv_id a conversation. Blank rows and rows that repeat role and text
    of an earlier one are deleted. Other columns are ignored; an empty table gives no rows.
    """
    return _stream(rows, chunk).mapInArrow(lambda b: _turns(b, chunk), TURNS)


def report(rows: DataFrame, conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Faults, cost, edits and a digest of the repair for each conv_id of conversations, repairing rows as repaired_turns does.

    A conversation without rows has zeros, no edits and the digest of the empty text. gaps is what is lacking
    between the least and the largest turn; null turns don't count.
    """
    found = _stream(rows, chunk).mapInArrow(lambda b: _reports(b, chunk), REPORT)
    every = conversations.select(F.col("conv_id").cast("long").alias("own")).distinct()
    joined = every.join(found, F.col("own").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("own").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def report_sql() -> str:
    """report() of damaged conversations in DuckDB's SQL."""
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    byte = f"list_prepend(4294967295::bigint, list_transform(string_split({key}, ''), lambda z: ascii(z)::bigint))"
    crc = f"xor(4294967295, list_reduce({byte}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"
    keep = {0: "case ini when 's' then t + v1 when 'u' then t + v2 else 999999999 end", 1: "case ini when 'u' then t + v2 else 999999999 end", 2: "case ini when 'a' then t + v3 else 999999999 end", 3: "case ini when 'u' then t + v2 else 999999999 end"}
    own = ", ".join(f"case when must then {DELETE} + v{s} else least({DELETE} + v{s}, {REROLE} + t + v{GIVEN[s][1]}, {keep[s]}) end as b{s}" for s in range(4))
    at = lambda alias, state: f"case {state} when 0 then {alias}.v0 when 1 then {alias}.v1 when 2 then {alias}.v2 else {alias}.v3 end"
    to, kept = "case w.s when 2 then 3 else 2 end", "case when w.s = 0 and ini = 's' then 1 when w.s <> 2 and ini = 'u' then 2 when w.s = 2 and ini = 'a' then 3 end"
    return f"""
with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as k from conversations),
e as (select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case k when 3 then [0, 1] else [0] end) as times from d where k <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from e),
q as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, role[1] as ini, lag(role[1]) over (partition by conv_id order by i) as last from r),
f as (select *, blank or again as must, (not blank and not again and cut)::int as t from q),
faults as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, sum(t) as truncated,
    count(*) filter (last is not null and last || ini not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
v as (select conv_id, n + 1 as i, {END[0]}::bigint as v0, {END[1]}::bigint as v1, {END[2]}::bigint as v2, {END[3]}::bigint as v3 from faults
    union all select conv_id, i, least(b0, {INSERT} + b2, {2 * INSERT} + b3), least(b1, {INSERT} + b2, {2 * INSERT} + b3), least(b2, {INSERT} + b3), least(b3, {INSERT} + b2)
    from (select f.conv_id, f.i, {own} from f join v on v.conv_id is not distinct from f.conv_id and f.i = v.i - 1)),
w as (select conv_id, 1::bigint as i, 0 as s, 0::bigint as k, '' as e, null::varchar as line from faults
    union all select conv_id, case e when 'I' then i else i + 1 end, case e when 'D' then s when 'K' then kept else dest end, k + 1, e,
        case e when 'K' then role || ':' || text when 'R' then given || ':' || text when 'I' then given || ':' end
    from (select w.conv_id, w.i, w.s, w.k, f.role, f.text, {kept} as kept, {to} as dest, case w.s when 2 then 'assistant' else 'user' end as given,
            case when {DELETE} + {at('y', 'w.s')} = {at('x', 'w.s')} then 'D' when {INSERT} + {at('x', to)} = {at('x', 'w.s')} then 'I' when not must and t + {at('y', f'({kept})')} = {at('x', 'w.s')} and {kept} is not null then 'K' else 'R' end as e
        from w join v x on x.conv_id is not distinct from w.conv_id and x.i = w.i left join v y on y.conv_id is not distinct from w.conv_id and y.i = w.i + 1
            left join f on f.conv_id is not distinct from w.conv_id and f.i = w.i where y.i is not null or {at('x', 'w.s')} > 0)),
walks as (select conv_id, string_agg(e, '' order by k) as audit, coalesce(string_agg(line, chr(10) order by k), '') as repaired from w group by conv_id),
costs as (select conv_id, v0 as cost from v where i = 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0) as illegal,
    coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join faults using (conv_id) left join walks using (conv_id) left join costs using (conv_id)"""
