"""Merkle manifest and conversation repair against plain Python."""
import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import conversations as cv
from linkflow.llm import grammar as g
from linkflow.llm import merkle as mk


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------------ Merkle manifest

def leaf(row, low=False):
    doc, source, lang, n, text = row
    text = text.translate(str.maketrans(mk.UPPER, mk.LOWER)) if low and text is not None else text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    """(top, [siblings of leaf i, joined, level by level], way to fold a digest up from leaf i)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            ways[k].append(("".join(runs[i // 16][:i % 16]), "".join(runs[i // 16][i % 16 + 1:])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, over = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, way in zip(own[s], trees[s][1]):
            whole = way + over[k]
            cur = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in whole:
                cur = sha(a + cur + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in whole)), cur, cur == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, n int, part string, place int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "p", 3) for r in rows], SCHEMA)


def some_rows():
    rows = [(i, f"s{i % 3}" if i % 2 else "big", "en" if i % 4 else None, i, f"Text {i} É") for i in range(700)]
    rows += [(7, "big", "en", 1, "REPEATED")] * 3 + [(None, "big", None, None, None), (None, None, None, None, "A"), (5000, None, "", 0, ""),
                                                      (5001, "é", "x", 1, "ABC" * 5000), (5002, "lone", "x", 1, "only"), (5005, "", "x", 1, "Ab")]
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_manifest_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(mk, "BLOCK", block)
    rows = some_rows()
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted(map(tuple, mk.verified_manifest(documents(spark, rows).repartition(5)).collect()), key=key)
    want = sorted(plain_manifest(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(got, key=key) == want
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    rows = [(5, "s", None, 3, "Abc")]
    assert list(map(tuple, mk.verified_manifest(documents(spark, rows)).collect())) == plain_manifest(rows)
    assert mk.verified_manifest(documents(spark, rows).limit(0)).collect() == []


def test_multiproof_of_some_leaves_asks_for_each_missing_node_once(spark):
    rows = some_rows()
    manifest = mk.build_manifest(documents(spark, rows))
    manifest = mk.Manifest(mk.materialize(manifest.leaves), mk.materialize(manifest.nodes))
    chosen = manifest.leaves.where("doc_id % 97 = 0")
    got = mk.prove(manifest, chosen).collect()
    want = {r[1]: (r[3], r[4]) for r in plain_manifest(rows)}
    assert {r.leaf: (r.root, sha(r.proof)) for r in got} == {leaf(r): want[leaf(r)] for r in rows if r[0] is not None and r[0] % 97 == 0}
    asked = mk.missing_nodes({0, 1, 17}, 300)
    assert len(asked) == len(set(asked)) == 14 + 15 + (16 - 2) + 1 + 2 - 2
    assert mk.missing_nodes(set(range(16)), 16) == []


# ------------------------------------------------------------------ conversation repair

STATES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_edits(symbols):
    """(cost, audit) by trying states one row at a time, with up to two inserts anywhere."""
    best = {0: (0, "")}

    def insert(best):
        for _ in range(2):
            for i, (c, a) in list(best.items()):
                for (k, role), j in STATES.items():
                    if k == i and role != "s" and (c + 5, a + "I") < best.get(j, (1 << 60, "")):
                        best[j] = (c + 5, a + "I")
        return best

    for role, fault in symbols:
        then, extra = {}, 5 if fault == "truncated" else 0
        for i, (c, a) in insert(dict(best)).items():
            moves = [(i, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                moves += [(j, c + extra, a + "K") for (k, r), j in STATES.items() if k == i and r == role]
                moves += [(j, c + 1 + extra, a + "R") for (k, r), j in STATES.items() if k == i and r != "s" and r != role]
            for j, cost, audit in moves:
                if (cost, audit) < then.get(j, (1 << 60, "")):
                    then[j] = (cost, audit)
        best = then
    return min(v for j, v in insert(best).items() if j in (0, 3))


def plain_report(rows):
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            said = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((role, text))
        roles = [r[1][:1] for r in mine]
        cost, audit = plain_edits([(r if r in "sua" else "x", f) for r, f in zip(roles, faults)])
        lines, state, left = [], 0, iter(mine)
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if state == 2 else "user"
            state = STATES[state, role[0]]
            lines.append(f"{role}:{text}")
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return out


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, audit string, place int, digest string, kind int")


def conversation_rows():
    import random
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant", ""]
    rows = [(c, t, rnd.choice(roles), rnd.choice(["Yes.", "No", "  ", None, "Why?\n", "Same!", "", f"t{t}."])) for c in range(120) for t in range(rnd.randint(1, 9))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]             # one long conversation
    rows += [(901, t, rnd.choice(roles), rnd.choice(["Yes.", "No"]) + str(t) + rnd.choice([".", ""])) for t in range(2500)]
    rows += [(902, None, "user", "A."), (902, None, "assistant", "B."), (902, 4, "user", "x" * 100_000), (902, 2, "user", "A.")]
    rows += [(None, 1, "user", "Who?"), (None, None, "assistant", "Me."), (903, 5, "user", "Twice."), (903, 5, "user", "Twice."), (904, None, None, None)]
    return rows


def test_repair_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT_BITS", 6)
    rows = conversation_rows()
    got = {r[0]: tuple(r) for r in cv.repair_report(turns(spark, rows).repartition(4)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {r[0]: r for r in plain_report(rows)}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert max(r[6] for r in want.values()) > 1000


def test_repair_of_no_rows(spark):
    assert cv.repair_report(turns(spark, []).limit(0)).collect() == []


def test_repaired_turns_have_the_wanted_order(spark):
    rows = turns(spark, conversation_rows())
    by = {}
    for r in cv.repaired_turns(rows, cv.summaries(rows)).collect():
        by.setdefault(r.conv_id, []).append((r.place, r.role[0]))
    for conv in by.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x for _, x in sorted(conv)))


SYMBOLS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([None, "blank", "truncated"])), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(SYMBOLS, min_size=1, max_size=6))
def test_grammar_gives_the_cheapest_edits(seqs):
    import numpy as np
    fault = {None: g.FINE, "blank": g.GONE, "truncated": g.CUT}
    coded = [np.array([g.symbol(r, fault[f]) for r, f in s]) for s in seqs] * 2
    for s, m in zip(seqs * 2, g.matrices(coded)):
        assert g.best(m) == plain_edits(s)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8))
def test_grammar_round_trip(seqs):
    import numpy as np
    rules, short = g.compress([np.array(s, int) for s in seqs], 4)
    assert len(short) == len(seqs)

    def written(x):
        return [int(x)] if x < 4 else written(rules[x - 4][0]) + written(rules[x - 4][1])

    for s, c in zip(seqs, short):
        assert [y for x in c for y in written(x)] == s
    flat = [p for c in short for p in zip(c.tolist(), c[1:].tolist()) if p[0] != p[1]]
    assert len(flat) == len(set(flat))          # no pair is left twice


def test_short_rows_by_trying_every_edit():
    """All edit strings of up to two inserts a gap, on all conversations of two rows."""
    def outcomes(symbols):
        for edits in itertools.product("KRD", repeat=len(symbols)):
            for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
                audit = "".join("I" * n + e for n, e in zip(gaps, [*edits, ""]))
                state, cost, left = 0, 0, iter(symbols)
                for e in audit:
                    role, fault = next(left) if e != "I" else (None, None)
                    if e == "D":
                        cost += 2
                        continue
                    if fault == "blank":
                        break
                    want = role if e == "K" else "a" if state == 2 else "u"
                    cost += {"K": 0, "R": 1, "I": 5}[e] + (5 if fault == "truncated" else 0)
                    state = STATES.get((state, want))
                    if state is None:
                        break
                else:
                    if state in (0, 3):
                        yield cost, audit
    cells = list(itertools.product("suax", [None, "blank", "truncated"]))
    for symbols in itertools.product(cells, repeat=2):
        assert min(outcomes(symbols)) == plain_edits(symbols)


def test_ropes_compare_like_strings():
    a = g.Rope("")
    b = g.Rope("")
    text = ""
    for k in range(40):
        a = a + g.Rope("KD" * k)
        b = b + g.Rope("K") + g.Rope("DK" * k) if k % 2 else b + g.Rope("KD" * k)
        text += "KD" * k
    assert str(a) == text
    assert (a < b) == (str(a) < str(b)) and (b < a) == (str(b) < str(a))
    assert not a < a
