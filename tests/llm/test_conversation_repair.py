import hashlib
import random
from itertools import product

import duckdb
import pytest

from tiermark.llm.conversation_repair import OP13_SQL, Trellis, options, damaged, op13, repair

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def all_edits(rows):
    """Every sequence of edits of up to two insertions at a place, tried one by one: (cost, initials, repaired rows)."""
    best = None
    faults, seen = [], set()
    for role, text in rows:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    each = []
    for (role, text), fault in zip(rows, faults, strict=True):
        late = fault == "truncated"
        acts = [("D", 3, ())]
        if fault not in ("blank", "duplicate"):
            acts += [("K", late, ((role, text),)), ("R", 2 + late, (("user", text),)), ("R", 2 + late, (("assistant", text),))]
        each.append([(i, a) for i in inserts for a in acts])
    full = {"u": ("user", ""), "a": ("assistant", "")}
    for ways in product(*each):
        for tail in inserts:
            out = [x for i, a in ways for x in (*[full[k] for k in i], *a[2])] + [full[k] for k in tail]
            roles = "".join(r[:1] for r, _ in out)
            body = roles[1:] if roles.startswith("s") else roles
            if out and (not body or body != "ua" * (len(body) // 2) or any(not r for r, _ in out)):
                continue
            cost = sum(2 * len(i) + a[1] for i, a in ways) + 2 * len(tail)
            audit = "".join("I" * len(i) + a[0] for i, a in ways) + "I" * len(tail)
            key = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
            best = key if best is None else min(best, key)
    return best, faults


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(seed, n, longest):
    some = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(some.randrange(1, longest + 1)):
            rows.append((conv, turn, some.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), some.choice(["", " \n", "Yes.", "No!", "cut off", f"t{turn}.", f"t{turn}"])))
    return rows


@pytest.mark.parametrize("long", [0, 1000])
def test_equals_every_edit_tried(spark, long):
    rows = made(4, 60, 3)
    got = {r.conv_id: r for r in repair(frame(spark, rows), long=long, segment=2).collect()}
    assert len(got) == 60
    for conv in range(60):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        (cost, audit, text), faults = all_edits(mine)
        x = got[conv]
        assert (x.cost, x.audit, x.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), mine
        assert (x.blank, x.duplicate, x.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert x.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))


def test_segments_give_what_whole_conversations_give(spark):
    rows = made(9, 5, 200)
    rows += [(None, None if t % 7 == 0 else t // 3, r, x) for t, (_, _, r, x) in enumerate(made(2, 3, 100))]
    df = frame(spark, rows * 1)
    want = sorted(map(tuple, repair(df).collect()), key=repr)
    assert sorted(map(tuple, repair(df, long=0, segment=9).collect()), key=repr) == want
    said = [tuple(r)[3:] for r in repair(df, messages=True, long=0, segment=9).where("conv_id is null").orderBy("part", "place").collect()]
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() == next(r[-1] for r in want if r[0] is None)
    whole = [tuple(r)[3:] for r in repair(df, messages=True).where("conv_id is null").orderBy("part", "place").collect()]
    assert whole == said


def test_equal_rows_of_a_long_conversation(spark):
    df = frame(spark, [(1, None, "user", "same.")] * 300)
    r = repair(df, long=10, segment=20).first()
    assert (r.duplicate, r.cost, r.gaps, r.illegal) == (299, 299 * 3 + 2, 0, 299) and len(r.audit) == 301
    assert r.audit == repair(df).first().audit


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 5, "user", "Hi."), (1, 9, "assistant", "x" * 100_000 + "."), (2, 0, "s", "Only a system row."), (None, 3, "user", "Lost.")]
    df = frame(spark, rows).selectExpr("*", "'clash' as digest", "1 as part", "'c' as audit")
    got = {r.conv_id: r for r in repair(df).collect()}
    assert (got[1].gaps, got[1].blank, got[1].audit) == (3, 1, "DKK")
    assert got[2].audit == "D" and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].audit == "KI" and got[None].cost == 2
    assert repair(df.where("false")).count() == 0
    assert repair(df.where("false"), messages=True).count() == 0


def test_damage(spark):
    """Kinds by a CRC by zlib; a conversation that loses all its rows still has a report, however long it was."""
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(8)]
    kind = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    got = sorted((r.conv_id, r.turn, r.role, r.text, r.gone) for r in damaged(frame(spark, rows)).collect())
    want = []
    for c, t, r, x in rows:
        k = kind(c, t)
        want += [(c, t, "user" if k == 4 else r, "" if k == 1 else "A b c" if k == 2 else x, k == 0)] * (2 if k == 3 else 1)
    assert got == sorted(want)
    dropped = next((c, t) for c in range(40) for t in range(8) if kind(c, t) == 0)
    for long in (0, 5):
        r = repair(damaged(frame(spark, [(*dropped, "user", "x")] * 3)), long=long).collect()
        assert [tuple(x) for x in r] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_memory_is_that_of_what_is_unresolved():
    trellis, out = Trellis(0), 0
    for i in range(10_000):
        out += len(trellis.feed(options("ua"[i % 2], False, False)))
        assert i + 1 - out < 30


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    want = sorted(con.execute(OP13_SQL).fetchall())
    assert sorted(map(tuple, op13(spark, SF).collect())) == want and any("I" in r[7] for r in want)
