"""Structure repair of conversations: faults, and the cheapest edits to a lawful order of roles.

Rows are sorted into ranges of (conversation, turn). Conversations that lie inside one range
are finished in its task. Those at a range's edges may go on in the next; their rows are
chunks of ``viterbi``, one for each range: duplicates across chunks are found by key, chunk
summaries stitched, and each chunk traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.llm import viterbi
from folioflow.llm.tables import own_columns, written

RANGE_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
COUNTS = "gaps", "blank", "duplicate", "truncated", "illegal", "cost"
_LAWFUL = {"su", "ua", "au"}
_SPACES = b" \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by crc32(``conv_id:turn``) modulo 20; nulls count as a space.

    0 drops the row (it stays as a mark, ``dropped``, so that its conversation is known),
    1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    named = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind = F.col("kind")
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    return (
        own_columns(rows, "conv_id", "turn", "role", "text")
        .withColumn("kind", F.crc32(named.cast("binary")) % 20)
        .select(
            "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            (kind == 0).alias("dropped"),
            F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _initial(role: bytes) -> str:
    first = role[:1].decode("ascii", "replace")
    return first if first in ("s", "u", "a") else "-"


class _Talk:
    """Rows of one conversation, or of one chunk of it, as they come in order."""

    def __init__(self, name: str | None, conv_id: object) -> None:
        self.name, self.conv_id = name, conv_id
        self.seen: set[bytes] = set()
        self.rows: list[tuple[bytes, bytes, int]] = []  # role, text, fault
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.last_turn = None
        self.turns = self.illegal = 0
        self.first_kind = self.last_kind = ""

    def fault(self, text: bytes, digest: bytes) -> int:
        shown = text.rstrip(_SPACES)
        if not shown:
            return BLANK
        if digest in self.seen:
            return DUPLICATE
        self.seen.add(digest)
        return 0 if shown[-1:] in (b".", b"!", b"?") else TRUNCATED

    def add(self, turn: int | None, role: bytes, text: bytes, fault: int) -> None:
        self.rows.append((role, text, fault))
        self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        kind = _initial(role)
        if self.last_kind:
            self.illegal += self.last_kind + kind not in _LAWFUL
        self.first_kind = self.first_kind or kind
        self.last_kind = kind

    def signs(self) -> list[int | None]:
        return [
            None if fault in (BLANK, DUPLICATE) else viterbi.symbol(_initial(role), fault == TRUNCATED)
            for role, _, fault in self.rows
        ]

    def edits(self, vector: viterbi.Vector, state: int, last: bool) -> Iterator[tuple[str, bytes]]:
        """Letters and repaired lines, each line after a newline, for each row and the end."""
        signs = self.signs()
        for letters, sign, (role, text, _) in zip(viterbi.trace(signs, vector, state), signs, self.rows, strict=True):
            lines, state = _lines(letters, sign, state, role, text)
            yield letters, lines
        if last:
            letters = viterbi.CLOSING[state]
            yield letters, _lines(letters, None, state, b"", b"")[0]


def _lines(letters: str, sign: int | None, state: int, role: bytes, text: bytes) -> tuple[bytes, int]:
    """Repaired lines that edits of one row leave, and the state after them."""
    lines = b""
    for letter in letters:
        if letter == viterbi.INSERT:
            lines += b"\n" + viterbi.ROLES[state] + b":"
            state = viterbi._NEXT[state]
        elif letter == viterbi.REROLE:
            lines += b"\n" + viterbi.ROLES[state] + b":" + text
            state = viterbi._NEXT[state]
        elif letter == viterbi.KEEP:
            lines += b"\n" + role + b":" + text
            state = viterbi._KEPT[viterbi.KINDS[sign >> 1]][state]
    return lines, state


def _finished(talk: _Talk) -> tuple:
    """A whole conversation's counts, audit and hash."""
    live = [s for s in talk.signs() if s is not None]
    vectors, constants = viterbi.backwards(live)
    gone = talk.faults[BLANK] + talk.faults[DUPLICATE]
    cost = constants[-1] + vectors[-1][viterbi.START] + viterbi.DELETE_COST * gone
    audit, digest, skip = [], hashlib.sha256(), 1
    for letters, lines in talk.edits(viterbi.END, viterbi.START, True):
        audit.append(letters)
        digest.update(lines[skip:])
        skip = 0 if lines else skip
    gaps = 0 if talk.low is None else talk.high - talk.low + 1 - talk.turns
    return gaps, *talk.faults[1:], talk.illegal, cost, "".join(audit), digest.hexdigest()


def _ranges(id_type: str, turn_type: str) -> str:
    """Finished conversations, and the rows of those that may go on in another range."""
    results = ", ".join(f"{c} long" for c in COUNTS)
    return (
        f"conv_id {id_type}, name string, part int, seq long, turn {turn_type}, role binary, text binary, "
        f"digest binary, dropped boolean, fault int, {results}, audit string, repaired_sha256 string"
    )


def _portions(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Rows in lists of about so many bytes of text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or b"") + 256
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _work(schema: pa.Schema):
    """One sorted range: inner conversations are finished, rows of the first and the last passed on."""
    results = len(COUNTS) + 2
    blank = (None,) * (len(schema) - 1 - results)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq = TaskContext.get().partitionId(), 0
        talk: _Talk | None = None
        first = True
        held: list[tuple] = []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "name", "turn", "role", "text", "digest", "dropped"))
            for conv_id, name, turn, role, text, digest, dropped in zip(*columns, strict=True):
                if talk is None or name != talk.name:
                    if talk is not None and not first:
                        yield (talk.conv_id, *blank, *_finished(talk))
                    first, held, talk = talk is None, [], _Talk(name, conv_id)
                fault = 0 if dropped else talk.fault(text, digest)
                row = (conv_id, name, part, seq, turn, role, text, digest, dropped, fault, *(None,) * results)
                seq += 1
                if first:
                    yield row
                    continue
                held.append(row)
                if not dropped:
                    talk.add(turn, role, text, fault)
        yield from held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _portions(worked(batches), 6):
            columns = zip(zip(*rows, strict=True), schema.types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], schema=schema)

    return run


def _chunk(rows: pa.Table) -> _Talk:
    """A chunk's rows in order, without the dropped ones."""
    columns = [c for c in ("name", "conv_id", "turn", "role", "text", "dropped", "fault") if c in rows.column_names]
    talk = None
    for row in rows.sort_by("seq").select(columns).to_pylist():
        talk = talk or _Talk(row["name"], row["conv_id"])
        if not row["dropped"]:
            talk.add(row["turn"], row["role"], row.get("text"), row["fault"])
    return talk


_SUMMARY = (
    "name string, part int, conv_id {id}, low {turn}, high {turn}, turns long, blank long, duplicate long, "
    "truncated long, illegal long, first_kind string, last_kind string, ways array<long>"
)


def _summaries(schema: pa.Schema):
    """What the walk over a conversation's chunks has to know of one."""

    def run(rows: pa.Table) -> pa.Table:
        talk = _chunk(rows)
        ways = [x for to, cost, states in viterbi.summary([s for s in talk.signs() if s is not None]) for x in (to, cost, *states)]
        one = [talk.name, rows["part"][0].as_py(), talk.conv_id, talk.low, talk.high, talk.turns]
        one += [*talk.faults[1:], talk.illegal, talk.first_kind, talk.last_kind, ways]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(one, schema.types, strict=True)], schema=schema)

    return run


_STITCHED = "name string, part int, first boolean, last boolean, vector int, state int, conv_id {id}, " + ", ".join(
    f"{c} long" for c in COUNTS
)


def _stitch(schema: pa.Schema):
    """True vector and state of each chunk of a conversation, and the conversation's counts."""

    def run(rows: pa.Table) -> pa.Table:
        chunks = rows.sort_by("part").to_pylist()
        vector, cost = viterbi.NUMBER[viterbi.END], 0
        entered = []
        for chunk in reversed(chunks):
            entered.append(vector)
            way = chunk["ways"][6 * vector : 6 * vector + 6]
            chunk["states"] = way[2:]
            vector, cost = way[0], cost + way[1]
        cost += viterbi.VECTORS[vector][viterbi.START]
        turns = illegal = 0
        last_kind, last_turn = "", None
        states = [viterbi.START]
        for chunk in chunks:
            states.append(chunk["states"][states[-1]])
            turns += chunk["turns"] - (chunk["low"] is not None and chunk["low"] == last_turn)
            last_turn = chunk["high"] if chunk["high"] is not None else last_turn
            if chunk["first_kind"]:
                illegal += bool(last_kind) and last_kind + chunk["first_kind"] not in _LAWFUL
                last_kind = chunk["last_kind"]
            illegal += chunk["illegal"]
        total = {c: sum(x[c] for x in chunks) for c in ("blank", "duplicate", "truncated")}
        cost += viterbi.DELETE_COST * (total["blank"] + total["duplicate"])
        low = next((x["low"] for x in chunks if x["low"] is not None), None)
        gaps = 0 if low is None else last_turn - low + 1 - turns
        out = [
            (x["name"], x["part"], i == 0, i + 1 == len(chunks), v, s, x["conv_id"], gaps, *total.values(), illegal, cost)
            for i, (x, v, s) in enumerate(zip(chunks, reversed(entered), states[:-1], strict=True))
        ]
        columns = zip(zip(*out, strict=True), schema.types, strict=True)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in columns], schema=schema)

    return run


_PIECES = "name string, part int, piece long, letters string, lines binary"


def _traced(rows: pa.Table, places: pa.Table) -> pa.Table:
    """A chunk's letters and repaired lines, in pieces."""
    place = places.to_pylist()[0]
    talk = _chunk(rows)
    out = []
    for held in _portions(talk.edits(viterbi.VECTORS[place["vector"]], place["state"], place["last"]), 1):
        letters, lines = zip(*held, strict=True)
        out.append((place["name"], place["part"], len(out), "".join(letters), b"".join(lines)))
    columns = zip(*out, strict=True) if out else [()] * 5
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "part", "piece", "letters", "lines"]
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation from its pieces in order; texts stream through the hash."""

    def row() -> pa.RecordBatch:
        made = [pa.array([name]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(made, ["of", "audit", "repaired_sha256"])

    name, audit, digest, skip = None, [], hashlib.sha256(), 1
    for batch in batches:
        for of, letters, lines in zip(*(batch.column(c).to_pylist() for c in ("name", "letters", "lines")), strict=True):
            if of != name:
                if name is not None:
                    yield row()
                name, audit, digest, skip = of, [], hashlib.sha256(), 1
            audit.append(letters)
            digest.update(lines[skip:])
            skip = 0 if lines else skip
    if name is not None:
        yield row()


def _edges(rows: DataFrame, id_type: str, turn_type: str) -> DataFrame:
    """Results of the conversations whose rows lie at the edges of ranges."""
    open_rows = (F.col("fault").isin(0, TRUNCATED)) & ~F.col("dropped")
    # One row of a (conversation, text) for each range at most: later ones are settled in the range.
    earlier = F.row_number().over(W.partitionBy("name", "digest").orderBy("part"))
    fresh = rows.filter(open_rows).withColumn("fault", F.when(earlier > 1, DUPLICATE).otherwise(F.col("fault")))
    marked = written(fresh.unionByName(rows.filter(~open_rows)).drop("digest"), "chunks")

    def shape(text: str) -> T.StructType:
        return T.StructType.fromDDL(text.format(id=id_type, turn=turn_type))

    summed, stitched = shape(_SUMMARY), shape(_STITCHED)
    places = written(
        marked.drop("text")
        .groupBy("name", "part")
        .applyInArrow(_summaries(to_arrow_schema(summed)), summed)
        .groupBy("name")
        .applyInArrow(_stitch(to_arrow_schema(stitched)), stitched),
        "places",
    )
    pieces = (
        marked.groupBy("name", "part").cogroup(places.groupBy("name", "part")).applyInArrow(_traced, _PIECES)
    )
    hashed = (
        pieces.repartition("name")
        .sortWithinPartitions("name", "part", "piece")
        .select("name", "letters", "lines")
        .mapInArrow(_hashed, "of string, audit string, repaired_sha256 string")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        places.filter("first")
        .join(hashed, F.col("name") == F.col("of"), "left")
        .select(
            "conv_id", *COUNTS, F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


def repair(rows: DataFrame) -> DataFrame:
    """Faults of each conversation of ``rows`` (conv_id, turn, role, text) after ``damaged``, and its repair.

    Result, one row for each conv_id that occurs: gaps (turns missing between the least and
    the greatest), blank, duplicate and truncated (rows by their first fault), illegal
    (neighbours that are not system-user, user-assistant or assistant-user), cost of the
    cheapest edits, audit (their initials: Keep, Rerole, Delete, Insert; ties least in ASCII)
    and repaired_sha256 (of ``role:text`` lines).

    Rows come by turn, null turns first; rows of one turn by role, then by the hash of role
    and text. Null roles and texts count as one space, which is no lawful role and a blank
    text. Rows with a null conv_id are a conversation. Repeated rows are duplicates. A
    conversation whose rows are all dropped has zeros and an empty audit. An empty table gives
    no rows; extra columns are ignored. A very long text is one row of its task.

    Texts are shuffled once into ranges, so that a conversation of any size is dealt over
    ranges; only rows at their edges move again. The audit and the hash of a conversation are
    one value each: its repaired lines stream through one task at the end, piece by piece.
    """
    spark = rows.sparkSession
    after = damaged(rows)
    id_type, turn_type = (after.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES, 1)
    name: Column = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary")))
    # Rows that tie in all keys are alike; the salt lets ranges cut between them.
    salt = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col("name"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest"), F.col("salt")]
    ranged = (
        after.withColumns({"name": name, "digest": digest, "salt": salt})
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("conv_id", "name", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "digest", "dropped")
    )
    shape = T.StructType.fromDDL(_ranges(id_type, turn_type))
    done = written(ranged.mapInArrow(_work(to_arrow_schema(shape)), shape), "conversations")
    edges = _edges(done.filter("name IS NOT NULL").drop(*COUNTS, "audit", "repaired_sha256"), id_type, turn_type)
    inner = done.filter("name IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    return inner.unionByName(edges)
