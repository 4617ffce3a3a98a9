"""Conversation repair against a plain search over whole strings, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import repair

TURNS = "conv_id long, turn long, role string, text string, cost long, _conv string, fault string"
LEGAL = re.compile("(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", None) for r in rows], TURNS)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "ok" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Every way to edit, kept by what was written so far, as whole strings: least cost, then least letters."""
    best = {"": (0, "", ())}

    def put(into, roles, value):
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        state = roles[-2:] if roles[-1:] == "u" else roles[-1:]
        old = into.get(state)
        if old is None or value[:2] < old[:2]:
            into[state] = value

    def inserts(now):
        for _ in range(3):
            for state, (cost, audit, done) in list(now.items()):
                for role in ("user", "assistant"):
                    put(now, state_roles(done) + role[0], (cost + 3, audit + "I", (*done, (role, ""))))
        return now

    def state_roles(done):
        return "".join(r[:1] for r, _ in done)

    for (_, role, text), fault in zip(rows, faults_of(rows)):
        after = {}
        for cost, audit, done in inserts(best).values():
            put(after, state_roles(done), (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            put(after, state_roles(done) + (role[:1] or "?"), (cost + extra, audit + "K", (*done, (role, text))))
            for new in ("user", "assistant"):
                put(after, state_roles(done) + new[0], (cost + 3 + extra, audit + "R", (*done, (new, text))))
        best = after
    ends = [v for v in inserts(best).values() if LEGAL.fullmatch(state_roles(v[2]))]
    return min(ends, key=lambda v: v[:2])


def plain_digest(turns):
    """The contract without the damage, for rows whose nulls are one space already."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in turns:
        convs[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = {t for t, _, _ in rows if t is not None}
        faults = faults_of(rows)
        starts = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        cost, audit, done = plain_repair(rows)
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv_id] = (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def damage(turns):
    out = []
    for conv_id, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv_id, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def conversations(seed, n, most=14):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        roles = rng.choice([["user", "assistant"], ["assistant"], ["user"], ["system", "user", "assistant", "tool", "", None, "User", "usher"]])
        words = rng.choice([["a.", "b!", "c", "", " \t", None, "é?\n"], ["x."], ["q. "]])
        for k in range(rng.randint(1, most)):
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[k % 2]
            text = rng.choice(words) + str(k) + "." if rng.random() < 0.4 and None not in words else rng.choice(words)
            out.append((i if i else None, rng.choice([k, k, k, k + 5, None]), role, text))
    return out


def rows_of(frame):
    return {r["conv_id"]: tuple(r) for r in frame.collect()}


@pytest.mark.parametrize("segment", [10_000, 3, 1])
def test_against_all_edits(spark, segment):
    turns = conversations(5, 250 if segment > 3 else 60, 14)
    assert rows_of(repair.digest(table(spark, turns), segment)) == plain_digest(turns)


@pytest.mark.parametrize("segment", [10_000, 2])
def test_query_is_the_contract(spark, tmp_path, segment):
    turns = conversations(9, 120, 6)
    table(spark, turns).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(repair.query(spark, str(tmp_path), segment))
    want = plain_digest(damage(turns))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {i: want.get(i, (i, *empty)) for i in {t[0] for t in turns}}


def test_survivors_free_what_is_certain():
    """A long sound conversation leaves no letters behind; one that stays open keeps letters only."""
    letters = bytearray()
    paths = repair.Survivors(repair.START, letters.extend)
    for k in range(5_000):
        paths.step("ua"[k % 2], repair.OK)
        assert sum(len(n.letters) for e in paths.ends if e for n in e[1].line()) < 60
    assert paths.finish() == 0 and bytes(letters) == b"K" * 5_000
    paths = repair.Survivors(repair.START, bytearray().extend)
    for _ in range(5_000):
        paths.step("a", repair.OK)
        nodes = {id(n) for e in paths.ends if e for n in e[1].line()}
        assert len(nodes) < 12


@pytest.mark.parametrize("segment", [10_000, 700])
def test_long_conversation(spark, segment):
    rng = random.Random(2)
    turns = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", f"text {k}.", f"cut {k}", ""])) for k in range(3_000)]
    turns += [(1, 10**6, "user", "same."), (1, 10**6, "user", "same.")] * 400 + [(2, 0, "user", "hi."), (2, 1, "assistant", "yes.")]
    got = rows_of(repair.digest(table(spark, turns), segment))
    few = rows_of(repair.digest(table(spark, turns)))
    assert got == few and got[2][6:8] == (0, "KK") and got[1][3] > 700


def test_repaired_rows_come_back(spark):
    turns = [(7, 0, "system", "Be kind."), (7, 1, "assistant", "Hello."), (7, 2, "user", " "), (7, 3, "tool", "42.")]
    found = repair.repair(table(spark, turns)).orderBy("place").collect()
    assert [(r["edit"], r["fault"], r["new_role"], r["text"]) for r in found] == [
        ("K", "ok", "system", "Be kind."), ("R", "ok", "user", "Hello."), ("D", "blank", None, " "), ("R", "ok", "assistant", "42."),
    ]
    assert sum(r["cost"] for r in found) == 10


def test_empty_table(spark):
    assert repair.digest(table(spark, [])).collect() == [] and repair.repair(table(spark, [])).collect() == []


def test_sql_is_the_contract(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    turns = conversations(11, 150, 8)
    table(spark, turns).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = {r[0]: r for r in con.execute(repair.SQL).fetchall()}
    want = plain_digest(damage(turns))
    assert {k: got[k] for k in want} == want and len(got) == 150
