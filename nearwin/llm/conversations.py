"""Repair of conversations: the cheapest edits that give roles in turn, by layers of reachable grammar states a cost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwin.plans.shared import small_batches, unsent, written

#: White space, as in words elsewhere; and the signs that end what is said.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Turns whose layers are made at a time.
STRETCH = 128
#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: A turn's code: its role's initial (0 s, 1 u, 2 a, 3 another), and whether it is truncated or must go.
INITIALS, OPEN, GONE = "sua", 4, 8
#: States of s?(ua)+ or nothing: 0 nothing so far, 1 after s, 2 after u, 3 after ua. Where a turn by initial leads, and the
#: only one of user and assistant that may come next.
STEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
NEXT, SAID = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: What it costs to end in each state: an answer after u, both after s.
FINISH = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60


def before(step: dict[int, int]) -> list[int]:
    """For each set of states (bits), the set of states that the step leads into it."""
    return [sum(1 << s for s, to in step.items() if states >> to & 1) for states in range(16)]


KEPT, FED = [before(step) for step in STEP], before(dict(enumerate(NEXT)))


def layers(codes: bytes, end: tuple[int, ...], wanted: int) -> list[list[int]]:
    """For each cost from 0 on, and each place, the set of states from which the turns from there on can be finished so cheaply.

    ``end`` is what it costs to finish after the last turn in each state. The last layer is the first that has all states
    of the set ``wanted`` before the first turn. A set is four bits: what a turn kept, given another role or deleted, or
    one inserted before it, leads to in the layers that much cheaper.
    """
    n, found, none = len(codes), [], [0] * (len(codes) + 1)
    cheaper = lambda c: found[c] if c >= 0 else none
    while not found or found[-1][0] & wanted != wanted:
        c = len(found)
        inserted, deleted = cheaper(c - INSERT), cheaper(c - DELETE)
        plain, cut = (None, cheaper(c - REROLE)), (cheaper(c - CUT_OFF), cheaper(c - REROLE - CUT_OFF))
        row = [0] * (n + 1)
        row[n] = states = sum(1 << s for s in range(4) if end[s] <= c)
        for i in range(n - 1, -1, -1):
            code = codes[i]
            now = deleted[i + 1] | FED[inserted[i]]
            if code < OPEN:
                now |= KEPT[code][states] | FED[plain[1][i + 1]]
            elif code < GONE:
                now |= KEPT[code & 3][cut[0][i + 1]] | FED[cut[1][i + 1]]
            row[i] = states = now
        found.append(row)
    return found


def cheapest(found: list[list[int]], state: int) -> int:
    return next(c for c, row in enumerate(found) if row[0] >> state & 1)


def trace(codes: bytes, found: list[list[int]], state: int) -> tuple[str, int]:
    """(letters, state at the end): the edits of least cost from a state on, of equal ones the least letters."""
    n, i, c, letters = len(codes), 0, cheapest(found, state), []
    has = lambda cost, at, s: cost >= 0 and found[cost][at] >> s & 1
    while i < n:
        code, rise = codes[i], CUT_OFF if codes[i] & OPEN else 0
        to = STEP[code & 3].get(state)
        if has(c - DELETE, i + 1, state):
            letters.append("D")
            c, i = c - DELETE, i + 1
        elif has(c - INSERT, i, NEXT[state]):
            letters.append("I")
            c, state = c - INSERT, NEXT[state]
        elif code < GONE and to is not None and has(c - rise, i + 1, to):
            letters.append("K")
            c, i, state = c - rise, i + 1, to
        else:
            letters.append("R")
            c, i, state = c - REROLE - rise, i + 1, NEXT[state]
    return "".join(letters), state


def crossing(codes: bytes) -> list[int]:
    """Least cost from each state before the turns to each after them (4 x 4, row by row); NEVER where there is no way.

    Only deletions stay in 0; into 1 leads one kept s beside deletions; the ways into 2 and 3 come from ``layers``.
    """
    out = [[NEVER] * 4 for _ in range(4)]
    out[0][0] = out[1][1] = DELETE * len(codes)
    out[0][1] = min((DELETE * (len(codes) - 1) + (CUT_OFF if code & OPEN else 0) for code in codes if code & 3 == 0 and code < GONE), default=NEVER)
    for to in (2, 3):
        found = layers(codes, tuple(0 if s == to else NEVER for s in range(4)), 15)
        for state in range(4):
            out[state][to] = cheapest(found, state)
    return [x for row in out for x in row]


def keyed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, known, turn, role, digest, text: a turn's place in its conversation is (known, turn, role, digest), nulls first."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    return plain.select("conv", F.col("turn").isNotNull().alias("known"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")


ORDER = ["conv", "known", "turn", "role", "digest"]


def coded(rows: DataFrame) -> DataFrame:
    """(conv, known, turn, role, digest, n, code), a written table: a row for ``n`` equal turns, and the first one's code.

    A text is known by its digest. Equal turns are counted before they are shuffled; a turn repeats an earlier one if
    the least place of its role and text in the conversation is another.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate(INITIALS)), F.lit(3))
    slim = rows.select(*ORDER, (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("open"))
    kinds = written(slim.groupBy(*ORDER, "blank", "open").agg(F.count(F.lit(1)).alias("n")))
    first = kinds.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    first = first.select(F.col("conv").alias("__conv"), F.col("role").alias("__role"), F.col("digest").alias("__digest"), "first")
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    later = F.coalesce(F.struct("known", "turn") > F.col("first"), F.lit(False))
    code = initial + F.when(F.col("blank") | later, GONE).when(F.col("open"), OPEN).otherwise(0)
    return written(kinds.join(unsent(first), same, "left").select(*ORDER, "n", code.cast("int").alias("code")))


STRETCHES = "conv {0}, part long, seq long, codes binary, ways array<long>"


def stretches(kinds: DataFrame, most: int = STRETCH) -> DataFrame:
    """(conv, part, seq, codes, ways), a written table: the codes of runs of at most ``most`` turns of a conversation, in order.

    Rows are range-partitioned by conversation and place, so that a conversation of any size is cut, not kept together.
    ``ways`` (see ``crossing``) is null where the run is a whole conversation, which is sure inside a partition.
    """
    kind = kinds.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, any_yet = TaskContext.get().partitionId(), 0, [], False
        conv, codes, edge = None, bytearray(), True

        def flush(at_edge: bool) -> None:
            nonlocal seq
            out.append((conv, part, seq, bytes(codes), crossing(bytes(codes)) if at_edge else None))
            seq += 1
            codes.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.list_(pa.int64()))], names=["conv", "part", "seq", "codes", "ways"])

        for batch in batches:
            conv_type = batch.column("conv").type
            for c, n, code in zip(*(batch.column(x).to_pylist() for x in ("conv", "n", "code")), strict=True):
                if any_yet and c != conv:
                    flush(edge)
                    edge = False
                conv, any_yet = c, True
                first = True
                while n:
                    if len(codes) == most:
                        edge = True
                        flush(edge)
                    take = 1 if first else min(n, most - len(codes))
                    codes.extend(bytes([code if first else code & 3 | GONE]) * take)
                    first, n = False, n - take
                if len(out) >= 4096:
                    yield made()
                    out.clear()
        if any_yet:
            flush(True)
        if out:
            yield made()

    places = [F.col(c).asc_nulls_first() for c in ORDER]
    dealt = kinds.repartitionByRange(*places).sortWithinPartitions(*places).select("conv", "n", "code")
    return written(small_batches(dealt).mapInArrow(cut, STRETCHES.format(kind)))


def ended(parts: DataFrame) -> DataFrame:
    """(part, seq, ends): for each run of a cut conversation, what it costs to finish after it from each state.

    A conversation's matrices, one a run of STRETCH turns, are taken in together: 128 bytes for 128 turns.
    """

    def back(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        ends, end = [], list(FINISH)
        for ways in reversed(group["ways"].tolist()):
            ends.append(end)
            end = [min(int(ways[4 * s + to]) + end[to] for to in range(4)) for s in range(4)]
        return pd.DataFrame({"part": group["part"], "seq": group["seq"], "ends": ends[::-1]})

    return parts.select("conv", "part", "seq", "ways").groupBy("conv").applyInPandas(back, "part long, seq long, ends array<long>")


TRACED = "conv {0}, part long, seq long, codes binary, letters array<string>, exits array<int>"


def traced(parts: DataFrame) -> DataFrame:
    """``parts`` with letters and exits: the edits from each state on (only from 0 where a run is whole), and the state after them."""
    kind = parts.schema["conv"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, exits = [], []
            for codes, ends in zip(batch.column("codes").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                starts = range(1) if ends is None else range(4)
                end = FINISH if ends is None else tuple(e - min(ends) for e in ends)
                found = layers(codes, end, sum(1 << s for s in starts))
                ways = [trace(codes, found, s) for s in starts]
                letters.append([w[0] for w in ways])
                exits.append([w[1] for w in ways])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq", "codes")), pa.array(letters, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=["conv", "part", "seq", "codes", "letters", "exits"])

    return small_batches(parts).mapInArrow(look, TRACED.format(kind))


def chosen(parts: DataFrame) -> DataFrame:
    """(conv, part, seq, codes, edits): of each run's letters those from the state in which the run before it ends."""
    kind = parts.schema["conv"].dataType.simpleString()
    whole = traced(parts.filter("ways IS NULL").select("conv", "part", "seq", "codes", F.lit(None).cast("array<bigint>").alias("ends")))
    cut = parts.filter("ways IS NOT NULL")
    several = written(traced(cut.join(unsent(ended(cut)), ["part", "seq"]).select("conv", "part", "seq", "codes", "ends")))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        state, entries = 0, []
        for exits in group["exits"]:
            entries.append(state)
            state = int(exits[state])
        return pd.DataFrame({"part": group["part"], "seq": group["seq"], "entry": entries})

    entries = several.select("conv", "part", "seq", "exits").groupBy("conv").applyInPandas(chain, "part long, seq long, entry int")
    picked = several.join(unsent(entries), ["part", "seq"]).select("conv", "part", "seq", "codes", F.get("letters", F.col("entry")).alias("edits"))
    return whole.select(F.col("conv").cast(kind), "part", "seq", "codes", F.get("letters", F.lit(0)).alias("edits")).unionByName(picked)


class Repair:
    """One conversation's record, made while its turns pass by in order."""

    def __init__(self, conv) -> None:
        self.conv, self.codes, self.edits = conv, bytearray(), []
        self.sha, self.any, self.at, self.letter, self.state = hashlib.sha256(), False, 0, 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.role = None
        self.text: str | None = None

    def line(self, role: str, text: bytes) -> None:
        self.sha.update((b"\n" if self.any else b"") + role.encode() + b":" + text)
        self.any = True

    def inserted(self) -> None:
        while self.text[self.letter : self.letter + 1] == "I":
            self.line(SAID[self.state], b"")
            self.state, self.cost, self.letter = NEXT[self.state], self.cost + INSERT, self.letter + 1

    def turn(self, turn: int | None, role: str, text: bytes) -> None:
        if self.text is None:
            self.text = "".join(self.edits)
        code, self.at = self.codes[self.at], self.at + 1
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        blank = not text.strip(b" \t\n\x0b\x0c\r")
        self.blank += blank
        self.duplicate += code >= GONE and not blank
        self.truncated += code < GONE and code & OPEN > 0
        if self.role is not None:
            self.illegal += self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        self.inserted()
        edit, self.letter = self.text[self.letter], self.letter + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += (CUT_OFF if code & OPEN else 0) + (REROLE if edit == "R" else 0)
        self.line(SAID[self.state] if edit == "R" else role, text)
        self.state = NEXT[self.state] if edit == "R" else STEP[code & 3][self.state]

    def record(self) -> tuple:
        self.text = "" if self.text is None else self.text
        end = FINISH[self.state] // INSERT
        self.text += "I" * end
        self.inserted()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.text, self.sha.hexdigest()


REPAIRED = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(turns: DataFrame, convs: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A conversation's turns are taken by turn, nulls first; turns that share one by role and then by their text's digest, so
    equal ones stand together. Its roles' initials must be nothing or s?(ua)+. Keeping a turn costs 0, giving it the role of user or
    assistant 2, deleting it 3, inserting an empty one of either 2; an undeleted truncated turn adds 1. Blank turns and
    those whose role and text came before must be deleted. ``audit``: the cheapest edits' initials, of equal ones the least.
    ``repaired_sha256``: of the repaired lines ``role:text``.

    ``convs`` gives more conversations by the same column, such as those of which no turn is left: zeros, an empty audit
    and the hash of nothing. A null conversation is one of its own. Null role or text: one space. An empty role has no
    initial and fits nowhere. Empty table: no rows. Other columns are not looked at.

    Edits come from slim rows without texts, cut into runs of ``stretch`` turns, so a conversation of any length is shared out. Texts are
    shuffled once, by conversation; they stream through the hash in order, and a hash of one conversation is one task's work.
    """
    rows = keyed(turns, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType.simpleString()
    ids = turns.select(F.col(conv_col).alias("conv"))
    ids = (ids if convs is None else ids.unionByName(convs.select(F.col(conv_col).alias("conv")))).distinct()
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    shape = {"part": "long", "seq": "long", "codes": "binary", "edits": "string", "known": "boolean", "turn": "long", "role": "string", "digest": "string", "text": "binary"}
    some = lambda df, kind_of, *has: df.select("conv", F.lit(kind_of).alias("kind"), *(F.col(c).cast(k).alias(c) if c in has else none(c, k) for c, k in shape.items()))
    edits = some(chosen(stretches(coded(rows), stretch)), 1, "part", "seq", "codes", "edits")
    every = some(ids, 0).unionByName(edits).unionByName(some(rows, 2, "known", "turn", "role", "digest", "text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = [x.split()[0] for x in REPAIRED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.column("conv").type
            for conv, of, codes, edits, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "codes", "edits", "turn", "role", "text")), strict=True):
                if of == 0:
                    if now is not None:
                        done.append(now.record())
                    now = Repair(conv)
                elif of == 1:
                    now.codes += codes
                    now.edits.append(edits)
                else:
                    now.turn(turn, role, text)
            if len(done) >= 1024:
                yield made()
                done.clear()
        if now is not None:
            done.append(now.record())
        if done:
            yield made()

    dealt = every.repartition("conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv", "kind", "part", "seq", "known", "turn", "role", "digest")))
    return small_batches(dealt).select("conv", "kind", "codes", "edits", "turn", "role", "text").mapInArrow(stream, REPAIRED.format(kind))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by rule: a turn's crc32 of ``conv_id:turn`` modulo 20 says what befalls it.

    0 drops it, 1 empties its text, 2 takes full stops, exclamation and question marks out, 3 repeats it, 4 gives it to the
    user. Nulls count as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    left = rows.withColumn("fate", fate).filter("fate != 0")
    return left.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
