"""Conversation repair against a plain search over all prefixes of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from conftest import FOLDER

from ledgerline.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = re.compile(r"(s?(ua)+)?")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows, faults):
    """Row by row: the least (cost, audit) of each last initial, with the rows it gives."""
    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, made) in list(states.items()):
                for role in ("user", "assistant"):
                    to = STEP.get((q, role[0]))
                    new = (cost + 3, audit + "I", made + [(role, "")])
                    if to and (to not in states or new[:2] < states[to][:2]):
                        states[to] = new
        return states

    states = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, made) in states.items():
            options = [(q, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options += [(STEP.get((q, r[:1])), price + more, edit, [(r, text)]) for r, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R"))]
            for to, price, edit, row in options:
                new = (cost + price, audit + edit, made + row)
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        states = inserted(after)
    return min((states[q] for q in ("", "a") if q in states), key=lambda s: s[:2])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows, before):
    groups = defaultdict(list, {r[0]: [] for r in before})
    for r in rows:
        groups[r[0]].append(r[1:])
    found = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in group:
            shown = WORD.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in group if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        cost, audit, made = cheapest([r[1:] for r in group], faults)
        assert PATTERN.fullmatch("".join(r[:1] for r, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def test_query_equals_brute_force(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r[0]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, folder).collect()}
    assert found == expected(damage(rows), rows) and len(found) == len({r[0] for r in rows})


@pytest.mark.parametrize("length", [3, 8, 40])
def test_both_searches_meet_at_the_least_audit(length):
    draw = random.Random(length)
    for _ in range(400):
        codes = "".join(draw.choice("uuaasoxUASO") for _ in range(draw.randint(0, length)))
        rows = [({"u": "user", "a": "assistant", "s": "system"}.get(c.lower(), "tool"), c) for c in codes]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in codes]
        assert repair.search(codes, 0, repair.ACCEPTED) == cheapest(rows, faults)[:2]


def test_segments_are_put_together(monkeypatch):
    draw = random.Random(7)
    monkeypatch.setattr(repair, "SEGMENT", 5)
    for _ in range(300):
        codes = "".join(draw.choice("uuaasoxUASO") for _ in range(draw.randint(0, 37)))
        audit = repair.Audit()
        for c in codes:
            audit.add(c)
        assert audit.result() == repair.search(codes, 0, repair.ACCEPTED)


EDGES = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 5, None, "What?"), (1, None, "user", "no end "),
    (2, None, None, None), (3, 2, "", "x."), (4, 1, "system", "S!"), (4, 2, "assistant", "A. \n"), (4, 2, "user", "U?\t"),
    (None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (None, None, "system", "日本。"), (6, 3, "assistant", "w " * 90_000 + "."),
    (7, 2**63 - 1, "user", "far."), (7, -(2**63), "assistant", "apart."),
] + [(8, i, "user" if i % 2 else "assistant", f"turn {i}" + "." * (i % 5 > 0)) for i in range(500)]
KIND = "conv_id long, turn long, role string, text string"


def test_edges(spark):
    rows = spark.createDataFrame(EDGES, KIND).selectExpr("*", "'p' AS part", "1 AS digest", "2 AS kind", "3 AS copy", "4 AS cost", "5 AS initial", "6 AS last").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damaged(rows)).collect()}
    assert found == expected(damage(EDGES), EDGES)
    again = {r[0]: tuple(r)[1:] for r in repair.repaired(rows.where("role IS NOT NULL")).collect()}
    plain = [(c, t, r, " " if x is None else x) for c, t, r, x in EDGES if r is not None]
    assert again == expected(plain, plain)


def test_repaired_turns_are_what_the_digest_covers(spark):
    rows = repair.damaged(spark.createDataFrame(EDGES, KIND))
    turns = defaultdict(list)
    for r in sorted(repair.repaired(rows, turns=True).collect(), key=lambda r: r["position"]):
        assert r["position"] == len(turns[r["conv_id"]]) and r["edit"] in "KRI"
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in repair.repaired(rows).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(turns[r["conv_id"]]).encode()).hexdigest()


def test_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert repair.repaired(repair.damaged(none)).count() == repair.repaired(none, turns=True).count() == 0
    # a conversation whose rows are all dropped keeps its row
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repaired(repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], KIND))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
