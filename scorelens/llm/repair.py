"""Conversation structure repair by depth-first branch and bound over edits.

A conversation should read `(s?(ua)+)?`: perhaps a system turn, then user and
assistant by turns. The cheapest edits that get there are searched over an
explicit stack: lower bounds of what the rows to come cost at least cut branches that
can't reach the incumbent, children go in the order of the edits' initials, and
a dominance table per node (rows read, state) cuts a prefix that costs no less
than one seen there. Prefixes of equal cost at a node never extend each other,
so the one met first is the ASCII-least, and what is left when the stack runs
empty is proved optimal.

Rows are ordered by a range partitioning over (conv_id, turn, role, text), which cuts
a conversation of any length into runs, one per partition. A run that may go on
in another partition is searched from and to every state, and the runs of such
conversations (one per partition border at most) are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelens.llm.texts import only
from scorelens.session import settle

# What edits cost, and the states of the grammar: nothing yet, after s, after u, after a.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
NEVER = 1 << 40

RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
RUN = "known boolean, part bigint, place bigint, low bigint, high bigint, turns bigint, first_role string, last_role string, " \
      "rows bigint, costs array<bigint>, audits array<string>, role string, text string, fault int"  # fmt: skip

NO_FAULT, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)


def suffix_bounds(rows: list[tuple[str, int]], exits: tuple[int, ...]) -> list[list[int]]:
    """What rows from i on cost at least from each state, if the last state is one of `exits`; rows are (initial, fault)."""
    bounds = [[NEVER] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = bounds[i]
        for state in range(4):
            if i == len(rows):
                here[state] = 0 if state in exits else NEVER
                continue
            initial, fault = rows[i]
            best = DELETE + bounds[i + 1][state]
            if fault not in (IS_BLANK, IS_DUPLICATE):
                extra = TRUNCATED if fault == IS_TRUNCATED else 0
                to = KEPT.get((state, initial))
                if to is not None:
                    best = min(best, extra + bounds[i + 1][to])
                best = min(best, REROLE + extra + bounds[i + 1][NEXT[state]])
            here[state] = best
        # An insertion moves on within the row; two rounds settle the cycle user -> assistant -> user.
        for _ in range(3):
            for state in range(4):
                here[state] = min(here[state], INSERT + here[NEXT[state]])
    return bounds


def cheapest(rows: list[tuple[str, int]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the best edits from `entry` to a state of `exits`; None where there are none."""
    bounds = suffix_bounds(rows, exits)
    incumbent, audit = bounds[0][entry], None
    if incumbent >= NEVER:
        return None
    seen: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, edit = stack.pop()
        del path[max(depth - 1, 0) :]
        if depth:
            path.append(edit)
        if cost + bounds[i][state] > incumbent or (audit is not None and cost + bounds[i][state] >= incumbent):
            continue
        if seen.get((i, state), NEVER) <= cost:
            continue
        seen[i, state] = cost
        if i == len(rows) and state in exits:
            # A longer audit from here only costs more.
            incumbent, audit = cost, "".join(path)
            continue
        children = []
        if i < len(rows):
            initial, fault = rows[i]
            children.append((i + 1, state, cost + DELETE, depth + 1, "D"))
        children.append((i, NEXT[state], cost + INSERT, depth + 1, "I"))
        if i < len(rows) and fault not in (IS_BLANK, IS_DUPLICATE):
            extra = TRUNCATED if fault == IS_TRUNCATED else 0
            to = KEPT.get((state, initial))
            if to is not None:
                children.append((i + 1, to, cost + extra, depth + 1, "K"))
            children.append((i + 1, NEXT[state], cost + REROLE + extra, depth + 1, "R"))
        stack.extend(reversed(children))
    return None if audit is None else (incumbent, audit)


class Mended:
    """Applies an audit to rows as they come: (role, text) of what stays or is put in."""

    def __init__(self, state: int = START):
        self.state = state

    def steps(self, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit == "K":
                self.state = KEPT[self.state, role[:1]]
            else:
                self.state = NEXT[self.state]
                role = ROLES[self.state]
            yield role, text


class Digest:
    """SHA-256 of `role:text` lines, a newline between."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, lines: Iterator[tuple[str, str]]) -> Digest:
        for role, text in lines:
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True
        return self


class Run:
    """Rows of one conversation that lie next to each other, in order."""

    def __init__(self, conv: int | None, place: int):
        self.conv, self.place = conv, place
        self.rows: list[tuple[str, str, int]] = []
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.counts = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        # The turn of the row before is nowhere else looked at; equal rows stand together.
        if fault in (NO_FAULT, IS_TRUNCATED) and self.rows and (turn, role, text) == self.last:
            fault = IS_DUPLICATE
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, role, text)
        self.counts[fault] += 1
        self.rows.append((role, text, fault))

    @property
    def coded(self) -> list[tuple[str, int]]:
        return [(role[:1], fault) for role, _, fault in self.rows]

    def lines(self) -> Iterator[tuple[str, str]]:
        return ((role, text) for role, text, _ in self.rows)

    def result(self) -> dict:
        cost, audit = cheapest(self.coded, START, FINAL)
        return {
            "conv_id": self.conv,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": self.counts[IS_BLANK],
            "duplicate": self.counts[IS_DUPLICATE],
            "truncated": self.counts[IS_TRUNCATED],
            "illegal": self.illegal,
            "cost": cost,
            "audit": audit,
            "repaired_sha256": Digest().add(Mended().steps(audit, self.lines())).hash.hexdigest(),
            "known": True,
        }

    def open(self, part: int) -> Iterator[dict]:
        """A row of the run's sums and its best edits between any two states, then its own rows."""
        tables = [cheapest(self.coded, a, (b,)) for a in range(4) for b in range(4)]
        head = {"conv_id": self.conv, "part": part, "known": False}
        yield head | {
            "place": -1,
            "low": self.low,
            "high": self.high,
            "turns": self.turns,
            "blank": self.counts[IS_BLANK],
            "duplicate": self.counts[IS_DUPLICATE],
            "truncated": self.counts[IS_TRUNCATED],
            "illegal": self.illegal,
            "first_role": self.rows[0][0] if self.rows else None,
            "last_role": self.rows[-1][0] if self.rows else None,
            "rows": len(self.rows),
            "costs": [NEVER if t is None else t[0] for t in tables],
            "audits": ["" if t is None else t[1] for t in tables],
        }
        for i, (role, text, fault) in enumerate(self.rows):
            yield head | {"place": i, "role": role, "text": text, "fault": fault}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: the rows after damage; there is false for a row that was dropped.

    Nulls in role and text read as one space, in the key too. Dropped rows stay
    as marks, so that a conversation that lost all its rows is still known.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    there = kind != 0
    rows = rows.select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"), there.alias("there"), times)
    return rows.drop("col")


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with `line` (their order within a turn) and `fault`; repeats in the same turn are left to the run."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"line": F.concat("role", F.lit(":"), "text"), "said": said})
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    met = rows.where("there").groupBy("conv_id", "said").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    again = settle(met.where("first != last").select("conv_id", "said", "first"), "said-again")
    same = rows["conv_id"].eqNullSafe(again["conv_id"]) & (rows["said"] == again["said"])
    rows = rows.join(again, same, "left").select(*(rows[c] for c in rows.columns), "first")
    text = F.rtrim("text", F.lit(BLANK_CHARS))
    fault = (
        F.when(text == "", IS_BLANK)
        .when(F.col("first") < order, IS_DUPLICATE)
        .when(~F.right(text, F.lit(1)).isin(*ENDS), IS_TRUNCATED)
        .otherwise(NO_FAULT)
    )
    return rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "there", "line", "fault")


def _named(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in rows:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(found: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("conv_id", "turn", F.substring("line", 1, 64)).sortWithinPartitions("conv_id", "turn", "line")


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Results of the conversations that lie within the partition, and the open runs at its two ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, first = None, True
    for place, (conv, turn, role, text, there, _, fault) in enumerate(_named(batches)):
        if run is None or conv != run.conv:
            if run is not None:
                if first:
                    yield from run.open(part)
                else:
                    yield run.result()
                first = False
            run = Run(conv, place)
        if there:
            run.add(turn, role, text, fault)
    if run is not None:
        yield from run.open(part)


class Joined:
    """Runs of one conversation put together: sums, and the best (cost, audit) that leads to each state."""

    def __init__(self, conv: int | None):
        self.conv, self.best = conv, {START: (0, "")}
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last_role = None

    def add(self, head: dict) -> None:
        for name in self.sums:
            self.sums[name] += head[name]
        if head["low"] is not None:
            self.sums["turns"] -= head["low"] == self.high
            self.low, self.high = head["low"] if self.low is None else self.low, head["high"]
        if head["rows"]:
            if self.last_role is not None:
                self.sums["illegal"] += self.last_role[:1] + head["first_role"][:1] not in LEGAL
            self.last_role = head["last_role"]
        # Of equal costs neither audit begins with the other, so the lesser one stays the lesser.
        onward: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.best.items():
            for to in range(4):
                more = head["costs"][4 * state + to]
                if more < NEVER:
                    found = (cost + more, audit + head["audits"][4 * state + to])
                    onward[to] = min(onward.get(to, found), found)
        self.best = onward

    def result(self, digest: str) -> dict:
        cost, audit = min(self.best[s] for s in FINAL if s in self.best)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        sums = {name: self.sums[name] for name in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": self.conv, "gaps": gaps, **sums, "cost": cost, "audit": audit, "repaired_sha256": digest}

    @property
    def audit(self) -> str:
        return min(self.best[s] for s in FINAL if s in self.best)[1]


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One result per conversation from its runs' heads, which come first, and rows, which are hashed as they come."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        joined = Joined(row["conv_id"])
        while row is not None and row["conv_id"] == joined.conv and row["place"] < 0:
            joined.add(row)
            row = next(rows, None)

        def own() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row["conv_id"] == joined.conv and row["place"] >= 0:
                yield row["role"], row["text"]
                row = next(rows, None)

        lines = own()
        digest = Digest().add(Mended().steps(joined.audit, lines))
        for _ in lines:
            pass
        yield joined.result(digest.hash.hexdigest())


def repair(rows: DataFrame, marked: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn, role and text; other columns are not looked at,
    whatever their names. A conversation's rows are taken by turn, null turns
    first, and within a turn by `role:text`, byte by byte; null roles and texts
    read as one space, and null conv_ids are one conversation. With `marked`,
    rows whose `there` is false only say that their conversation exists; one
    without any row has zeros, an empty audit and the hash of an empty text. A
    row's first fault counts: blank, duplicate (role and text seen before in the
    conversation), truncated. An empty table gives no rows. Rows equal in all
    four columns are held by one task, like the rows between two borders of the
    partitioning; everything else about a conversation's length is free.
    """
    there = F.col("there") if marked else F.lit(True)
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    number = lambda c: F.col(c).cast("bigint").alias(c)
    rows = rows.select(number("conv_id"), number("turn"), filled("role"), filled("text"), there.alias("there"))
    schema = f"{RESULT}, {RUN}"
    arrow = _arrow(rows.sparkSession, schema)
    found = settle(_ordered(_faults(rows)).mapInArrow(lambda b: _batches(_searched(b), arrow), schema), "conversation-runs")
    names = [part.split()[0] for part in RESULT.split(", ")]
    short = _arrow(rows.sparkSession, RESULT)
    runs = found.where("not known").repartition("conv_id").sortWithinPartitions("conv_id", F.col("place") >= 0, "part", "place")
    return found.where("known").select(*names).unionByName(runs.mapInArrow(lambda b: _batches(_joined(b), short), RESULT))


def repaired_turns(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations; `found` is what `repair(rows)` gave, if it is there already.

    The rows of a conversation stream past its audit in order.
    """
    found = repair(rows) if found is None else found
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"))
    turns = turns.withColumns({"line": F.concat("role", F.lit(":"), "text"), "row": F.lit(True)})
    audits = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("line"), F.lit(False).alias("row"))
    mixed = turns.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "line")
    ddl = "conv_id bigint, place bigint, role string, text string"
    arrow = _arrow(rows.sparkSession, ddl)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        stream = _named(batches)
        for conv, _, _, audit, _, row in stream:
            if not row:
                lines = ((role, text) for _, _, role, text, _, _ in stream)
                for place, (role, text) in enumerate(Mended().steps(audit, lines)):
                    yield {"conv_id": conv, "place": place, "role": role, "text": text}

    return mixed.mapInArrow(lambda b: _batches(each(b), arrow), ddl)
