"""Methods of earlier operators against plain Python: the network's gradients and states, MinHash bins, credential linking."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from linkflow.llm import fingerprints as fp
from linkflow.llm import language as lg
from linkflow.llm import oracles
from linkflow.llm import queries as llm
from linkflow.llm import secrets as sc
from linkflow.llm import words
from tests.oracle import compare

# ------------------------------------------------------------------ language network


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(4)
    d = lg.Direction(rng, 3)
    d.p = {k: v.astype(float) for k, v in d.p.items()}
    x = rng.integers(0, lg.PAD + 1, (7, 5))
    x[-1] = lg.PAD
    want = rng.normal(size=(7, 5, lg.HIDDEN))

    def after():
        kept, last = d.states(x)
        return kept, np.stack([k[0] for k in kept[1:]] + [last])

    def loss():
        return float((after()[1] * want).sum())

    grads = d.back(x, after()[0], want)
    for name, grad in zip(("Ez", "Ec", "Uz", "Uc"), grads):
        used = [(int(b), j) for b in set(x.ravel()) - {lg.PAD} for j in range(3)][:12] if name[0] == "E" else [(i, j) for i in range(3) for j in range(4)]
        for at in used:
            keep, eps = d.p[name][at], 1e-4
            d.p[name][at] = keep + eps
            up = loss()
            d.p[name][at] = keep - eps
            down = loss()
            d.p[name][at] = keep
            assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=2e-2, abs=2e-3), (name, at)


def test_positions_against_a_network_read_step_by_step():
    rng = np.random.default_rng(6)
    dirs = [lg.Direction(rng, 3), lg.Direction(rng, 3)]
    bias = rng.normal(size=3).astype(np.float32)
    weights = [d.p[k] for d in dirs for k in lg.Direction.KEYS] + [bias]
    steps = lg.STEP + 2 * lg.CONTEXT
    x = np.full((2, steps), lg.PAD)
    x[0, lg.CONTEXT:lg.CONTEXT + 40] = rng.integers(32, 120, 40)
    x[1] = rng.integers(32, 120, steps)
    inner = np.zeros(x.shape, bool)
    inner[0, lg.CONTEXT:lg.CONTEXT + 40] = True
    inner[1, lg.CONTEXT:-lg.CONTEXT] = True
    got = lg.position_sums(x.astype(np.int16), weights, inner)

    def walk(p, row, order):
        h, out = np.zeros(lg.HIDDEN), {}
        for t in order:
            if row[t] != lg.PAD:
                az, ac = p["Ez"][row[t]] + h @ p["Uz"], p["Ec"][row[t]] + h @ p["Uc"]
                z, c = (1 + az / (1 + abs(az))) / 2, ac / (1 + abs(ac))
                h = h + z * (c - h)
            out[t] = h
        return out

    for k in range(2):
        on, back = walk(dirs[0].p, x[k], range(steps)), walk(dirs[1].p, x[k], range(steps - 1, -1, -1))
        total = np.zeros(3)
        for t in np.flatnonzero(inner[k]):
            logits = on[t] @ dirs[0].p["V"] + back[t] @ dirs[1].p["V"] + bias
            e = np.exp(logits - logits.max())
            total += e / e.sum()
        np.testing.assert_allclose(got[k], total, rtol=1e-3, atol=1e-3)


def test_all_of_a_sampled_text_is_learned_from():
    far = ("en", b"a" * 3000 + b"b" * 3000)
    langs, params = lg.train([far, ("fr", b"c" * 6000)], rounds=60)
    ez = params[0]
    start = lg.Direction(np.random.default_rng(1), 2).p["Ez"]
    assert all(np.abs(ez[c] - start[c]).sum() > 0 for c in b"abc") and langs == ["en", "fr"]


# ------------------------------------------------------------------ fingerprints

def plain_bins(text, n_bins):
    data = text.encode()
    raw, off = words.text_buffers(pa.array([data]))
    _, _, doc, h = words.word_table(raw, off)
    shingles, _ = words.shingles(h, np.array([len(h)]))
    bins = [None] * n_bins
    for s in map(int, shingles):
        b = s >> (64 - n_bins.bit_length() + 1)
        bins[b] = s if bins[b] is None else min(bins[b], s)
    if all(b is None for b in bins):
        return None
    own = list(bins)
    for b in range(n_bins):
        attempt = 0
        while own[b] is None:
            attempt += 1
            probe = int(words.mix64(np.array([b + n_bins * attempt], np.uint64))[0]) & (n_bins - 1)
            own[b] = bins[probe]
    return [int(words.mix64(np.array([v], np.uint64))[0]) & (2 ** fp.BITS - 1) for v in own]


def test_bins_against_plain_python():
    rnd = random.Random(5)
    texts = ["", "one", "one two three four five six", " ".join(str(rnd.random()) for _ in range(40)), " ".join(str(rnd.random()) for _ in range(900))]
    for n_bins in (16, 256):
        got = fp.fingerprints(pa.array(texts), n_bins)
        for t, row in zip(texts, got):
            assert row.tolist() == (plain_bins(t, n_bins) or [255] * n_bins)


def test_likeness_against_the_exact_similarity():
    rnd = random.Random(8)
    errors = []
    for _ in range(60):
        base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(400)]
        other = [w if rnd.random() > .02 else "new" + w for w in base]
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        low = fp.fingerprints(pa.array([" ".join(base), " ".join(other)]))
        errors.append(float(fp.likeness(low[:1], low[1:])[0]) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < .02 and np.std(errors) < .06


# ------------------------------------------------------------------ credential linking

def plain_spans(text):
    """Every span against every other: what is near, what overlaps."""
    spans = []
    for rank, (kind, expr, group, least) in enumerate(sc.KINDS):
        for m in re.finditer(expr, text, re.A):
            ok = len(m[group]) >= least if kind != "opaque" else all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))
            if ok:
                spans.append((m.start(), rank, kind, m.end()))
    def near(a, kinds):
        return any(b != a and b[2] in kinds and (b[0] - a[3] if b[0] >= a[0] and (b[0], b[1]) > (a[0], a[1]) else a[0] - b[3]) <= sc.SCOPE for b in spans)
    out = []
    for s in spans:
        kind = s[2]
        if kind in sc.BASE:
            out.append(s)
            continue
        if any(b[2] in sc.BASE and b[0] < s[3] and s[0] < b[3] for b in spans):
            continue
        has_id, has_secret = near(s, sc.IDENTIFIER), near(s, sc.SECRET)
        if {"opaque": has_id, "ident": has_secret, "endpoint": has_id and has_secret}[kind]:
            out.append(s)
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(out))


def credential_texts():
    rnd = random.Random(9)
    ident, opaque, end = "user = joe_doe", "Ab3" * 9, "https://e.org/x"
    secret, access = "password=hunter2hunter2", "AKIA" + "B2" * 10
    texts = [f"{ident} {opaque}", opaque, ident, end, f"{ident} {opaque} {end}", f"{end} {secret}", f"{end} {access} {secret}", f"{access} {opaque}"]
    for gap in (198, 199, 200, 201, 202):
        texts += [ident + "-" * gap + opaque, opaque + "-" * gap + ident, f"{secret}{'-' * gap} {ident}", ident + " " * gap + end + " " * gap + opaque]
    texts += [f"token = {opaque}", f"secret: '{opaque}' {ident}", "0123456789abcdef" * 3 + "GHIJ01 " + ident, "é漢" * 30 + ident + "é" * 200 + opaque]
    pieces = [ident, opaque, end, secret, access, "0f" * 20, "plain words", "-" * 90, "é" * 40, "\n", "login: me", "client_id=abc123"]
    texts += [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    return texts


def test_linking_against_all_pairs(spark):
    texts = credential_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in sc.secret_spans(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t
    kinds = {k.split(":")[0] for s in got.values() for k in s.split(",") if k}
    assert kinds == {"assign", "access", "hex", "ident", "opaque", "endpoint"}


# ------------------------------------------------------------------ SQL of the operators

@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    ok, message = compare(llm.queries()[name](spark, sf), llm.oracle_sql()[name], sf)
    assert ok, message
    assert oracles
