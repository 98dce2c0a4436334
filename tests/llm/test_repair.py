import hashlib
import random
import zlib

import pytest
from tests.compare import mismatch

from tidewake.llm import registry, repair

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        role, text, kind = say(role), say(text), zlib.crc32(f"{say(conv_id)}:{say(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows, ids):
    """Cheapest edits by a queue ordered by cost and audit over (rows done, roles so far), without states or signatures."""
    import heapq
    import re

    out = []
    for conv_id in ids:
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            t = text.rstrip(SPACES)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        queue, done = [(0, "", 0, (), ())], set()
        while True:
            cost, audit, at, roles, lines = heapq.heappop(queue)
            shape = "".join(r[:1] or "-" for r in roles)
            if at == len(own) and re.fullmatch("(s?(ua)+)?", shape):
                break
            end = (at, shape[-1:], len(shape) == 1 and shape == "s")
            if (end, bool(shape)) in done and not audit.endswith("I"):
                continue
            if not audit.endswith("I"):
                done.add((end, bool(shape)))
            ways = [(2, "I", r, f"{r}:", 0) for r in ("user", "assistant")]
            if at < len(own):
                ways.append((3, "D", None, None, 1))
                if faults[at] not in ("blank", "duplicate"):
                    late = faults[at] == "truncated"
                    ways.append((late, "K", own[at][2], f"{own[at][2]}:{own[at][3]}", 1))
                    ways += [(2 + late, "R", r, f"{r}:{own[at][3]}", 1) for r in ("user", "assistant")]
            for more, edit, role, line, step in ways:
                if role is not None and not re.fullmatch("s?(ua)*u?", shape + (role[:1] or "-")):
                    continue
                heapq.heappush(queue, (cost + more, audit + edit, at + step, roles if role is None else (*roles, role), lines if role is None else (*lines, line)))
        out.append((conv_id, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, damage=True, kind="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, kind).repartition(3)
    return sorted((tuple(r) for r in repair.digest(df, repair.repair(repair.damage(df) if damage else df)).collect()), key=str)


def test_equals_its_sql(spark):
    assert mismatch(spark, "/root/testdata/sf0.01", registry.op11_conversations, registry.REPAIR_SQL) is None


def test_random_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in range(120):
        for t in range(r.randrange(9)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([f"Words {c} {t}.", f"no end {t}", "Same.", " \n", None, "what?\t"])))
    ids = sorted({c for c, *_ in rows})
    assert run(spark, rows) == brute(damaged(rows), ids)


def test_pieces_add_up(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), f"{t}{r.choice(['.', '', '!'])}") for c in range(6) for t in range(25)]
    whole = run(spark, rows)
    assert whole == brute(damaged(rows), range(6))
    for size in (1, 2, 5):
        assert list(_cut_locally(rows, size)) == whole


def _cut_locally(rows, size):
    """The operator's steps in plain Python with pieces of ``size`` rows."""
    rows = damaged(rows)
    for conv_id in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        piece, pieces, seen = None, [], set()
        whole = repair._Whole(conv_id)
        for _, turn, role, text in own:
            if piece is None or len(piece.codes) >= size:
                piece = repair._Piece(conv_id)
                pieces.append(piece)
            t = text.rstrip(SPACES)
            piece.add(turn, role, text, "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        solved = [repair.solve("".join(p.codes)) for p in pieces]
        rest = [[cost for cost, _ in repair._ENDS]]
        for answers in reversed(solved):
            rest.append([min(a[2] + rest[-1][a[1]] for a in answers if a[0] == s) for s in range(4)])
        rest = rest[::-1][1:]
        state = 0
        for k, (p, answers) in enumerate(zip(pieces, solved, strict=True)):
            s, behind, cost, _, audit = min((a for a in answers if a[0] == state), key=lambda a: (a[2] + rest[k][a[1]], a[3]))
            tail = repair._ENDS[behind][1] if k == len(pieces) - 1 else ""
            row = p.row(k)
            edits = [dict(zip(("edit", "role", "text"), e, strict=True)) for e in repair._replayed(row[2], audit + tail, s, p.roles, p.texts)]
            whole.add(audit + tail, cost, edits, row[4:8], row[8:10], row[10:13])
            state = behind
        yield whole.row()


def test_a_conversation_with_most_rows(spark):
    """Its rows lie in several tasks and in many pieces; a third of them are one row repeated."""
    r = random.Random(7)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} {r.choice('ab')}.") for t in range(900)] + [(1, 5, "user", "again.")] * 500 + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho")]
    got = run(spark, rows, damage=False)
    assert [(g[0], *g[1:7]) for g in got] == [(1, 0, 0, 499, 0, 2 + 498, 499 * 3 + 2), (2, 0, 0, 0, 1, 0, 1)]
    assert got[1][7] == "KK" and got[0][7].count("D") == 499 and len(got[0][7]) == 1401


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (3, None, "user", "x."), (3, None, "user", "x."), (4, 0, "user", "long " * 400_000 + "."), (4, 1, "assistant", "ok."), (5, 2, "", "x."), (6, 7, "assistant", "y.")]
    ids = [None, 3, 4, 5, 6]
    assert run(spark, rows) == brute(damaged(rows), ids)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "a.", "x", 1)], "conv_id long, turn long, role string, text string, piece string, n int")
    assert repair.digest(df, repair.repair(df)).collect()[0].audit == "KI"
    named = df.toDF("a.b", "t`t", "r", "said", "piece", "n")
    assert repair.digest(named, repair.repair(named, "a.b", "t`t", "r", "said"), "a.b").collect()[0].audit == "KI"


@pytest.mark.parametrize("signature", ["", "s", "sua", "suuaa", "aSUxd", "dddd", "ssss", "auauau", "UAua", "sda"])
def test_every_answer_is_a_cheapest_one(signature):
    """Against all edit strings of up to two inserted rows before each row."""
    import itertools

    best = {}
    choices = [[i + e for i in ("", "I", "II") for e in "DKR"] for _ in signature]
    for way in itertools.product(*choices) if len(signature) <= 4 else []:
        for first in range(4):
            state, cost, at, ok = first, 0, 0, True
            for edit in "".join(way):
                if edit == "I":
                    cost += 2
                    state = repair._AFTER[state]
                    continue
                code = signature[at]
                at += 1
                if edit == "D":
                    cost += 3
                    continue
                cost += code.isupper() + 2 * (edit == "R")
                low = code.lower()
                if code == "d" or edit == "R" and low == repair._EXPECTED[state]:
                    ok = False
                elif edit == "K" and low == "s" and state == 0:
                    state = 1
                elif edit == "K" and low != repair._EXPECTED[state]:
                    ok = False
                else:
                    state = repair._AFTER[state]
            if ok:
                best[first, state] = min(best.get((first, state), (1 << 60, "")), (cost, "".join(way)))
    got = {(s, t): (cost, audit) for s, t, cost, _, audit in repair.solve(signature)}
    if len(signature) <= 4:
        assert got == best
    assert all(len(a.replace("I", "")) == len(signature) for _, a in got.values())
