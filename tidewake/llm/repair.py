"""Repair of conversation structure: the cheapest edits that make roles alternate, found once for each distinct signature.

A conversation's rows, in order, become a string with one character a row: its role's initial, a capital if the row breaks off, or
``d`` if it must go. A signature is solved by memoised recursion over its rows and the state of
the grammar ``(s?(ua)+)?``; equal signatures are solved once, the answers are joined back and the edits replayed.

So that a conversation of any length is never held in one task, it is cut into pieces of at most ``PIECE`` rows. A piece is
solved for each state that it can begin and end in. A piece's edits end with one of its own rows (what is inserted behind belongs to
the next piece), so no answer is the beginning of another one, and comparing costs, then the first piece in which audits differ,
compares whole audits. The choice of states is a pass over the pieces from the end, for the cost that remains, and one from the
beginning: both stream a conversation's pieces, one row of numbers each, past four numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.llm.shared import column, materialize

PIECE = 128  #: rows in a piece
_TEXT = 1 << 20  #: characters in a piece, about: a longer text is a piece of its own
_SPACES = "\t\n\x0b\x0c\r "
#: States of the grammar: nothing yet, after the system's row, after the user's, after the assistant's.
_EXPECTED = "uuau"
_AFTER = (2, 2, 3, 2)
#: What ends a conversation in each state: its cost and edits.
_ENDS = ((0, ""), (4, "II"), (2, "I"), (0, ""))
_ROLES = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults planted by a checksum of id and turn.

    Of 20 kinds: 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the
    user's. A null role or text, and in the checksum a null id or turn, is one space.
    """
    named = conversations.select(column(conv_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), F.lit(" ")).alias("role"), F.coalesce(column(text_col), F.lit(" ")).alias("text"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return named.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def solve(signature: str) -> list[tuple[int, int, int, int, str]]:
    """(state before, state behind, cost, rank among the audits from that state before, audit): the cheapest edits of the piece, ties to the least audit."""
    n, known = len(signature), {}

    def best(at: int, state: int, inserted: int = 0) -> dict[int, tuple[int, str]]:
        if at == n:
            return {} if inserted else {state: (0, "")}
        if (found := known.get((at, state, inserted))) is not None:
            return found
        out: dict[int, tuple[int, str]] = {}

        def offer(cost, edit, rest):
            for behind, (more, audit) in rest.items():
                out[behind] = min(out.get(behind, (1 << 60, "")), (cost + more, edit + audit))

        offer(3, "D", best(at + 1, state))
        code = signature[at]
        if code != "d":
            late, initial = int(code.isupper()), code.lower()
            if initial == _EXPECTED[state]:
                offer(late, "K", best(at + 1, _AFTER[state]))
            else:
                offer(2 + late, "R", best(at + 1, _AFTER[state]))
            if initial == "s" and state == 0:
                offer(late, "K", best(at + 1, 1))
        if inserted < 2:  # a third would be in a state that was met before, only dearer
            offer(2, "I", best(at, _AFTER[state], inserted + 1))
        known[at, state, inserted] = out
        return out

    answers = []
    for state in range(4):
        found = best(0, state)
        order = sorted(found, key=lambda t: found[t][1])
        answers += [(state, t, found[t][0], order.index(t), found[t][1]) for t in found]
    return answers


def _replayed(signature: str, audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that remain; ``roles`` and ``texts`` hold the rows that needn't go."""
    rows, at = iter(zip(roles, texts, strict=True)), 0
    for edit in audit:
        if edit == "I":
            role, text = _ROLES[_EXPECTED[state]], ""
        else:
            role, text = next(rows) if signature[at] != "d" else ("", "")
            at += 1
            if edit == "D":
                continue
            if edit == "K" and signature[at - 1] in "sS":
                state = 1
                yield edit, role, text
                continue
            if edit == "R":
                role = _ROLES[_EXPECTED[state]]
        state = _AFTER[state]
        yield edit, role, text


_PIECES = "conv_id {id}, piece long, signature string, n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


class _Piece:
    def __init__(self, conv_id):
        self.conv_id, self.codes, self.counts, self.illegal, self.size, self.turns = conv_id, [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, []
        self.initials, self.roles, self.texts = ["", ""], [], []

    def add(self, turn, role, text, fault):
        initial = role[:1] or "-"
        if self.codes:
            self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
        else:
            self.initials[0] = initial
        self.initials[1] = initial
        if not self.codes or turn != self.turns[-1]:
            self.turns.append(turn)
        if fault:
            self.counts[fault] += 1
        if fault in ("blank", "duplicate"):
            self.codes.append("d")
        else:
            code = initial if initial in "sua" else "x"
            self.codes.append(code.upper() if fault else code)
            self.roles.append(role), self.texts.append(text)
            self.size += len(text)

    def full(self):
        return len(self.codes) >= PIECE or self.size >= _TEXT

    def row(self, place):
        turns = [t for t in self.turns if t is not None] or [None]
        return (self.conv_id, place, "".join(self.codes), len(self.codes), *self.counts.values(), self.illegal, *self.initials, turns[0], turns[-1], sum(t is not None for t in turns), self.roles, self.texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a task's sorted rows, numbered so that all tasks' pieces follow each other."""
    place, piece, out, schema = TaskContext.get().partitionId() << 33, None, [], None
    names = ["conv_id", "turn", "role", "text", "n", "blank", "again", "late"]
    for batch in batches:
        if schema is None:
            kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "{id}": batch.schema.field("conv_id").type}
            schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _PIECES.split(", "))])
        for conv_id, turn, role, text, n, blank, again, late in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True):
            first = "blank" if blank else "duplicate" if again else "truncated" if late else ""
            for k in range(n):
                if piece is not None and (piece.full() or piece.conv_id != conv_id):
                    out.append(piece.row(place))
                    place, piece = place + 1, None
                    if len(out) >= 256:
                        yield _batch(out, schema)
                        out = []
                if piece is None:
                    piece = _Piece(conv_id)
                piece.add(turn, role, text, first if k == 0 or blank else "duplicate")
    if piece is not None:
        yield _batch([*out, piece.row(place)], schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    answer = pa.struct([("state", pa.int32()), ("behind", pa.int32()), ("cost", pa.int32()), ("rank", pa.int32()), ("audit", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            signatures = batch.column(0).slice(at, 256)
            found = [[dict(zip(("state", "behind", "cost", "rank", "audit"), a, strict=True)) for a in solve(s)] for s in signatures.to_pylist()]
            yield pa.RecordBatch.from_arrays([signatures, pa.array(found, pa.list_(answer))], ["signature", "answers"])


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows, each with whether its conversation is another one than the row's before."""
    before = object()
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("conv_id")).to_pylist()
        for conv_id, *row in zip(ids, *[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True):
            yield conv_id, conv_id != before, *row
            before = conv_id


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _chosen(pieces: DataFrame) -> DataFrame:
    """piece, state, behind, tail (the edits behind a conversation's last piece), from conv_id, piece, and moves: array of (state, behind, cost, rank)."""
    id_type = pieces.schema["conv_id"].dataType.simpleString()

    def remaining(batches):
        def rows():
            for conv_id, new, piece, moves in _runs(batches, "piece", "moves"):
                if new:
                    rest = [cost for cost, _ in _ENDS]
                yield conv_id, piece, new, rest, moves
                rest = [min(m["cost"] + rest[m["behind"]] for m in moves if m["state"] == s) for s in range(4)]

        move = pa.list_(pa.struct([(c, pa.int32()) for c in ("state", "behind", "cost", "rank")]))
        return _batches(rows(), pa.schema([("conv_id", kind), ("piece", pa.int64()), ("last", pa.bool_()), ("rest", pa.list_(pa.int64())), ("moves", move)]))

    def forward(batches):
        def rows():
            for _, new, piece, last, rest, moves in _runs(batches, "piece", "last", "rest", "moves"):
                if new:
                    state = 0
                best = min((m for m in moves if m["state"] == state), key=lambda m: (m["cost"] + rest[m["behind"]], m["rank"]))
                yield piece, state, best["behind"], _ENDS[best["behind"]][1] if last else ""
                state = best["behind"]

        return _batches(rows(), pa.schema([("piece", pa.int64()), ("state", pa.int32()), ("behind", pa.int32()), ("tail", pa.string())]))

    kind = to_arrow_type(pieces.schema["conv_id"].dataType)
    moves = "array<struct<state int, behind int, cost int, rank int>>"
    back = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(remaining, f"conv_id {id_type}, piece long, last boolean, rest array<long>, moves {moves}")
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(forward, "piece long, state int, behind int, tail string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Repaired conversations in pieces: conv_id, piece (ascending along a conversation), audit, edits (array of edit, role, text), and the piece's counts.

    Rows stand by turn, nulls first; those of one turn by role, then by the SHA-256 of their text, so input order
    never matters. A row's first fault counts: blank (nothing but spaces), duplicate (role and text stood
    before in the conversation; repeated rows are duplicates of the first), truncated (the last character that isn't a space is
    none of ``.!?``). Keeping costs nothing, another role 2, deleting 3 (blank and duplicate rows must go), inserting an
    empty row 2, a truncated row that stays 1 more. Of the cheapest edits the least audit is taken. Null roles and texts are one space; a null id is a
    conversation of its own; roles with another initial than s, u and a, the empty one too, can only be changed or
    deleted. Very long texts are pieces of their own. Other columns aren't read. An empty table gives no piece.
    """
    named = rows.select(column(conv_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), F.lit(" ")).alias("role"), F.coalesce(column(text_col), F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(_SPACES))
    once = named.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))  # so that repeated rows, however many, are one
    each = materialize(once.select("*", F.sha2("text", 256).alias("key"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("late")), "turns")
    place: Column = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = each.groupBy("conv_id", "role", "key").agg(F.min(place).alias("first"), F.count("*").alias("__times")).where("__times > 1")
    firsts = materialize(firsts.select(F.col("conv_id").alias("__id"), F.col("role").alias("__role"), F.col("key").alias("__key"), "first"), "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("__id")) & (F.col("role") == F.col("__role")) & (F.col("key") == F.col("__key"))
    told = each.join(firsts, same, "left").withColumn("again", F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("key")]
    dealt = told.select("conv_id", "turn", "role", "key", "text", "n", "blank", "again", "late").repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = named.schema["conv_id"].dataType.simpleString()
    pieces = materialize(dealt.mapInArrow(_cut, _PIECES.format(id=id_type)), "pieces")
    answer = "array<struct<state int, behind int, cost int, rank int, audit string>>"
    solved = materialize(pieces.select("signature").distinct().mapInArrow(_solved, f"signature string, answers {answer}"), "solved")
    moves = F.transform("answers", lambda a: F.struct(a["state"].alias("state"), a["behind"].alias("behind"), a["cost"].alias("cost"), a["rank"].alias("rank")))
    short = pieces.select("conv_id", "piece", "signature").join(solved.select("signature", moves.alias("moves")), "signature")
    chosen = materialize(_chosen(short.select("conv_id", "piece", "moves")), "chosen")
    own = F.filter("answers", lambda a: (a["state"] == F.col("state")) & (a["behind"] == F.col("behind")))[0]
    audits = pieces.select("piece", "signature").join(chosen, "piece").join(solved, "signature").select("piece", "state", "tail", own.alias("own"))
    counts = ["n", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns"]
    whole = pieces.join(materialize(audits.select("piece", "state", F.concat("own.audit", "tail").alias("audit"), F.col("own.cost").cast("long").alias("cost")), "audits"), "piece")

    def replay(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            edits = [[dict(zip(("edit", "role", "text"), e, strict=True)) for e in _replayed(*r)] for r in zip(*[get(c).to_pylist() for c in ("signature", "audit", "state", "roles", "texts")], strict=True)]
            kept = ["conv_id", "piece", "audit", "cost", *counts]
            yield pa.RecordBatch.from_arrays([*map(get, kept), pa.array(edits, pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "text")])))], [*kept, "edits"])

    kinds = ", ".join(f"{c} {'string' if 'initial' in c else 'long'}" for c in counts)
    return whole.select("conv_id", "piece", "signature", "audit", "state", "roles", "texts", "cost", *counts).mapInArrow(replay, f"conv_id {id_type}, piece long, audit string, cost long, {kinds}, edits array<struct<edit string, role string, text string>>")


def digest(conversations: DataFrame, repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without pieces has zeros and the hash of nothing; null turns count in no gap. SHA-256 has no
    parallel form: a conversation's pieces are streamed past one hash in order, whatever their number, and never held together.
    """
    field = repaired.schema["conv_id"].dataType
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("conv_id", to_arrow_type(field)), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def rows():
            now = None
            for conv_id, new, audit, cost, edits, blank, duplicate, truncated, illegal, first_initial, last_initial, first_turn, last_turn, turns in _runs(batches, "audit", "cost", "edits", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "first_turn", "last_turn", "turns"):
                if new:
                    if now is not None:
                        yield now.row()
                    now = _Whole(conv_id)
                now.add(audit, cost, edits, (blank, duplicate, truncated, illegal), (first_initial, last_initial), (first_turn, last_turn, turns))
            if now is not None:
                yield now.row()

        return _batches(rows(), schema, 256)

    kinds = ", ".join(f"{c} long" for c in counts)
    found = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, f"conv_id {field.simpleString()}, {kinds}, audit string, repaired_sha256 string")
    ids = conversations.select(column(conv_col).alias("__id")).distinct()
    none = {c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return ids.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left").withColumns(none).select(F.col("__id").alias("conv_id"), *none)


class _Whole:
    """What a conversation's pieces add up to."""

    def __init__(self, conv_id):
        self.conv_id, self.hash, self.counts, self.cost, self.audit, self.lines = conv_id, hashlib.sha256(), [0] * 4, 0, [], 0
        self.initial, self.turn, self.ends, self.turns = None, None, [], 0

    def add(self, audit, cost, edits, counts, initials, turns):
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.initial is not None:
            self.counts[3] += self.initial + initials[0] not in ("su", "ua", "au")
            self.turns -= self.turn is not None and self.turn == turns[0]
        self.initial, self.turn = initials[1], turns[1]
        self.turns += turns[2]
        if turns[2]:
            self.ends = [self.ends[0] if self.ends else turns[0], turns[1]]
        tail = len(audit) - len(audit.rstrip("I"))  # only the last piece has edits behind its rows
        self.cost += cost + 2 * tail
        self.audit.append(audit)
        for e in edits:
            self.hash.update(f"{chr(10) if self.lines else ''}{e['role']}:{e['text']}".encode())
            self.lines += 1

    def row(self):
        gaps = self.ends[1] - self.ends[0] + 1 - self.turns if self.ends else 0
        return self.conv_id, gaps, *self.counts, self.cost, "".join(self.audit), self.hash.hexdigest()
