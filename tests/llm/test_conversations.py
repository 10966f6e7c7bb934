"""Repair of conversations against an enumeration of all edits and against plain Python over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from heliograph.llm import conversations as c
from heliograph.llm.shared import table

LAWFUL = re.compile(r"(s?(ua)+)?").fullmatch


def twin(rows):
    """(cost, audit, lines) by layers: the least (cost, audit) of every state after every row, inserts tried until none helps."""
    def inserts(best):
        for _ in range(4):
            for s, (cost, audit, lines) in list(best.items()):
                to = {"": "u", "s": "u", "a": "u", "u": "a"}[s]
                new = (cost + 5, audit + "I", [*lines, f"{'user' if to == 'u' else 'assistant'}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, lines) in inserts(best).items():
            ways = [(cost + 2, audit + "D", s, lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role and s + role[:1] in ("s", "u", "su", "ua", "au"):
                    ways.append((cost + more, audit + "K", role[:1], [*lines, f"{role}:{text}"]))
                to = "a" if s == "u" else "u"
                ways.append((cost + 1 + more, audit + "R", to, [*lines, f"{'user' if to == 'u' else 'assistant'}:{text}"]))
            for x, y, to, z in ways:
                if to not in new or (x, y) < new[to][:2]:
                    new[to] = (x, y, z)
        best = new
    return min(v for k, v in inserts(best).items() if k in ("", "a"))


def all_ways(rows):
    """Every edit of few rows with at most two inserts in a gap; the least (cost, audit)."""
    out = []
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            choices = []
            cost, audit = 0, ""
            for k, (edit, (role, _, fault)) in enumerate(zip([*edits, ""], [*rows, ("", "", "")])):
                audit += "I" * gaps[k] + edit
                cost += 5 * gaps[k]
                choices += [["u", "a"]] * gaps[k]
                if edit == "D" or not edit:
                    cost += 2 * (edit == "D")
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += 5 * (fault == "truncated") + (edit == "R")
                choices.append(["u", "a"] if edit == "R" else [role[:1] or "-"])
            else:
                if any(LAWFUL("".join(x)) for x in itertools.product(*choices)):
                    out.append((cost, audit))
    return min(out)


def as_rows(rows):
    kinds = {"": c.SOUND, "blank": c.BLANK, "duplicate": c.DUPLICATE, "truncated": c.TRUNCATED}
    return [(None, role, text, kinds[fault]) for role, text, fault in rows]


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant", ""]), f"t{k}.", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(n)]


def test_every_edit_of_few_rows():
    rng = random.Random(5)
    for n in range(4):
        for _ in range(25):
            rows = random_rows(rng, n)
            assert all_ways(rows) == twin(rows)[:2] == c.cheapest(as_rows(rows)), rows


def test_longer_conversations_and_blocks():
    rng = random.Random(6)
    for _ in range(300):
        rows = random_rows(rng, rng.randint(0, 40))
        cost, audit, lines = twin(rows)
        assert c.cheapest(as_rows(rows)) == (cost, audit)
        assert [f"{r}:{t}" for _, _, r, t in c.apply(as_rows(rows), audit)] == lines
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        blocks = [as_rows(rows)[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
        solved = [c.all_cheapest(b) for b in blocks]
        total, ways = c.through([x[:2] for x in solved])
        joined = "".join(x[2][4 * s + t] for x, (s, t) in zip(solved, ways, strict=True)) + c.CLOSE[ways[-1][1]][1]
        assert (total, joined) == (cost, audit)


def expected(rows):
    """The contract's row of one conversation from its damaged (turn, role, text) in order."""
    seen, faults, out = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            out[fault] += 1
    out["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out["cost"], out["audit"], lines = twin([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return out | {"repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}, lines


def whole_table(rows):
    given = {}
    for conv, turn, role, text in rows:
        own = given.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: expected(sorted(own, key=key)) for conv, own in given.items()}


def same(got, want):
    got = {None if r["conv_id"] is None else int(r["conv_id"]): {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got}
    assert got == {k: v[0] for k, v in want.items()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "conversations")
    want = whole_table([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert any(v[0]["cost"] for v in want.values())
    same(c.query(spark, sf).collect(), want)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"Text {k}.", f"Text {k}"])) for k in range(400)]
    rows += [(8, 3, "user", "The same.")] * 60 + [(8, None, "assistant", None), (8, None, None, "x."), (8, 9, "assistant", "Good. \n")]
    rows += [(None, 1, "user", "No id."), (None, None, None, None), (9, None, "user", "é" * 50000 + "."), (11, 0, "", ""), (12, 2**40, "user", "a."), (12, -5, "assistant", "b.")]
    return rows + [(conv, turn, "user" if turn % 2 == 0 else "assistant", "Fine.") for conv in range(100, 140) for turn in range(4)]


def test_odd_rows_in_blocks_over_tasks(spark, odd_rows):
    """One conversation over many tasks and blocks, equal rows, nulls, long texts, a clashing column."""
    df = spark.createDataFrame([(*r, 1) for r in odd_rows], "conv_id long, turn long, role string, text string, digest int").repartition(5)
    want = whole_table(odd_rows)
    for most in (4096, 7):
        same(c.repair(c.damage(df), most=most).collect(), want)
    lines = {}
    for r in c.repaired(c.damage(df), most=50).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert lines == {k: v[1] for k, v in want.items() if v[1]}
    assert c.repair(c.damage(df.limit(0))).count() == 0
    assert c.repaired(c.damage(df.limit(0))).count() == 0
