"""Structure repair and the prefix trie against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest

from tidemark.llm import prefix_trie, structure_repair

SHAPE = "conv_id long, turn long, role string, text string, first_row string, x string"
EDGES = [
    (None, None, None, None),
    (None, 3, "user", "Hi."),
    (1, None, "assistant", None),
    (1, 1, "user", "a?"),
    (1, 1, "user", "a?"),
    (1, 2, "assistant", "ß… 𝄞 no end  \t"),
    (1, 2, None, "!"),
    (-150, 0, "system", "Be good."),
    (-150, 1, "tool", "x."),
    (-150, 9, "assistant", "x."),
    (-100, 0, "user", "\x0b\r\n"),
    (205, 0, "user", "one."),
    (207, 5, "", ""),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SHAPE)


def made_up(seed, convs=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c * 7 - 40, rnd.choice([t, t, t, None, t + 1]), rnd.choice(["user", "assistant", "system", "assistant", "user", "other", None]), rnd.choice(["a.", "b!", "c", "", " ", "d?", None, "e\n", "é."])))
    return rows


def cheapest(rows):
    """All edits of rows (role, text, fault), tried state by state; (cost, audit, lines)."""
    names = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def put(states):
        out = dict(states)
        for _ in range(3):
            for last, (cost, audit, lines) in list(out.items()):
                to = names[last]
                new = (cost + 5, audit + "I", (*lines, full[to] + ":"))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for role, text, fault in rows:
        new = {}

        def offer(state, found, new=new):
            if state not in new or found[:2] < new[state][:2]:
                new[state] = found

        for last, (cost, audit, lines) in put(best).items():
            offer(last, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            first = role[:1]
            if (first == "s" and last == "") or (first == names[last] and first in "ua"):
                offer(first, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            offer(names[last], (cost + more + 1, audit + "R", (*lines, f"{full[names[last]]}:{text}")))
        best = new
    return min((v for k, v in put(best).items() if k in ("", "a")), key=lambda v: v[:2])


def expected_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
            kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_equals_brute_force(spark, bits):
    rows = EDGES + made_up(5)
    turns = table(spark, rows)
    got = structure_repair.summary(turns, structure_repair.damage(turns), bits).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected_repair(rows)


def test_repair_of_one_long_conversation(spark):
    rnd = random.Random(3)
    rows = [(4, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["same.", f"{i}.", f"{i}"])) for i in range(700)]
    turns = table(spark, rows)
    got = structure_repair.summary(turns, structure_repair.damage(turns), 4).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == expected_repair(rows)


def test_repair_gives_turns(spark):
    turns = table(spark, [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "user", ""), (1, 3, "system", "c.")])
    _, edits, _ = structure_repair.repair(turns)
    got = [(r.edit, r.role, r.text, r.cost) for r in edits.orderBy("row", "step").collect()]
    assert [g[0] for g in got] == list("DKDR") and got[1][1:3] == ("user", "b.") and got[3][1:3] == ("assistant", "c.") and got[0][1:3] == (None, None)
    assert sum(g[3] for g in got) == 5


def test_repair_of_nothing(spark):
    turns = table(spark, [])
    assert structure_repair.summary(turns, structure_repair.damage(turns)).collect() == []


def expected_trie(rows, rebuilt=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    if rebuilt:
        rem = lambda c: c - int(abs(c) % 100 * (1 if c >= 0 else -1))  # noqa: E731  as SQL's remainder
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(rem(c), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(own[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "piece"), [(1, 1), (12, 8)])
def test_trie_equals_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", block)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", piece)
    rnd = random.Random(9)
    stem = [("user", "go"), ("assistant", "ok"), ("user", ""), (None, "é𝄞"), ("system", None)]
    rows = EDGES[:4] + EDGES[7:]
    for c in range(-130, 230, 3):
        n = rnd.choice([0, 1, 2, 3, 4, 5])
        rows += [(c, i, *stem[i]) for i in range(n)] + [(c, n + i, rnd.choice(["user", "assistant"]), rnd.choice("ab")) for i in range(rnd.choice([0, 1, 3]))]
    rows += [(300, i, "user", str(i % 3)) for i in range(40)] + [(c, None if i == 0 else i, "user", "copy") for c in range(400, 420) for i in range(6)]
    turns = table(spark, rows)
    placed = prefix_trie.place_turns(turns)
    assert sorted(map(tuple, prefix_trie.trie(*prefix_trie.share_heads(*placed)).collect()), key=str) == sorted(expected_trie(rows), key=str)
    assert sorted(map(tuple, prefix_trie.prefix_trie(turns).collect()), key=str) == sorted(expected_trie(rows, False), key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "a")])).collect() == []
