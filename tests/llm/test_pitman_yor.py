"""The Pitman-Yor model against plain Python over its own seating, and its sums against definitions."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linkflow.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slab string, kind int, side int, key string, n string"


def rows_of(n=150):
    rnd = random.Random(3)
    words = ["the", "The", "cat", "dog", "über", "ran", "x" * 40, "\u0000odd", "漢字", "and", "a"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Long word " * 3000), (1004, "same"), (1004, "same"), (None, "no id"),
                   (1005, "never seen zebra"), (1010, "tabs\tand\x0blines\r\n")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 2, "k", "n") for i, t in rows], SCHEMA).repartition(3)


def tokens(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def grams(t, order=py.ORDER):
    data = b"\n" * (order - 1) + b"".join(w.encode() + b" " for w in tokens(t)) + b"\n"
    return [sum(data[i - k] << 8 * k for k in range(order)) for i in range(order - 1, len(data))]


@pytest.mark.parametrize("slab", [20_000])
def test_scores_against_plain_python(spark, monkeypatch, slab):
    monkeypatch.setattr(py, "SLAB_BYTES", slab)
    rows = rows_of()
    seen = Counter(w for i, t in rows if not held_out(i) for w in [*tokens(t), None])
    n, v = sum(seen.values()), len(seen)
    counts = Counter(g for i, t in rows if not held_out(i) for g in grams(t))
    every = {g for _, t in rows for g in grams(t)}
    table = spark.createDataFrame([(g, counts[g]) for g in every], "key long, c long")
    p = {r.key: r.p for r in py.averaged(table).collect()}
    got = py.score_texts(documents(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(((i, held_out(i), len(tokens(t)) + 1, sum(seen[w] > 0 for w in [*tokens(t), None]), n,
                    sum(math.log10((seen[w] + .1) / (n + .1 * (v + 1))) for w in [*tokens(t), None]),
                    sum(math.log10(p[g]) for g in grams(t))) for i, t in rows), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)
        assert a[7] == pytest.approx(10 ** (-b[6] / b[2]), rel=1e-4)


def test_model_against_plain_python(spark):
    rows = rows_of()
    counts = Counter(g for i, t in rows if not held_out(i) for g in grams(t))
    every = {g for _, t in rows for g in grams(t)}
    table = spark.createDataFrame([(g, counts[g]) for g in every], "key long, c long")
    for levels, discount in py.samples(table):
        seats = {k: {r.key: (r.c, r.t) for r in rows.collect()} for k, rows in levels.items()}
        total = {k: Counter() for k in seats}
        for k, dishes in seats.items():
            for g, (c, t) in dishes.items():
                total[k][g >> 8, "c"] += c
                total[k][g >> 8, "t"] += t
                assert (t == 0) if c == 0 else 1 <= t <= c
        assert {g: c for g, (c, _) in seats[py.ORDER].items()} == {g: counts[g] for g in every}
        for k in range(py.ORDER, 1, -1):               # tables are the parents' customers
            sent = Counter()
            for g, (_, t) in seats[k].items():
                sent[g & (1 << 8 * (k - 1)) - 1] += t
            assert all(c == sent[g] for g, (c, _) in seats[k - 1].items())

        def p(g, k):
            if k == 0:
                return 1 / 256
            c, t = seats[k].get(g, (0, 0))
            all_c, all_t = total[k][g >> 8, "c"], total[k][g >> 8, "t"]
            shorter = p(g & (1 << 8 * (k - 1)) - 1, k - 1)
            return shorter if not all_c else (c - discount[k] * t + (py.STRENGTH + discount[k] * all_t) * shorter) / (all_c + py.STRENGTH)

        for r in levels[py.ORDER].collect():
            assert r.p == pytest.approx(p(r.key, py.ORDER), rel=1e-12)
        for context in {g >> 8 for g in list(every)[:40]}:
            assert sum(p(context << 8 | b, py.ORDER) for b in range(256)) == pytest.approx(1)


def test_reseating_follows_the_predictive_rule():
    rnd, n = random.Random(1), 4000
    for c, others, parent, d in [(2, 5, .1, .7), (12, 30, .02, .5), (31, 3, .4, .8)]:
        key = np.arange(n, dtype=np.int64)
        got = py.reseated(key, np.full(n, c), np.full(n, others), np.full(n, parent), d, 7)
        drawn = []
        for _ in range(n):
            t = 1
            for seated in range(1, c):
                new = (py.STRENGTH + d * (others + t)) * parent
                t += rnd.random() < new / (new + seated - d * t)
            drawn.append(t)
        assert abs(got.mean() - np.mean(drawn)) < 4 * np.std(drawn) / n ** .5 * 2 ** .5 + 1e-9
        assert abs(got.std() - np.std(drawn)) < .1 * np.std(drawn)
    many = py.reseated(key[:50], np.full(50, 10_000_000), np.full(50, 0), np.full(50, .1), .5, 7)
    assert (many >= 1).all() and 3 < many.mean() < 100


def test_better_than_the_base_on_held_out_texts(spark):
    got = [r for r in py.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_nothing_is_written_that_is_not_read_again(spark, monkeypatch):
    """Answers go straight to their slabs, and of the longest grams only the kept sweeps' probabilities are written."""
    tables = []
    monkeypatch.setattr(py, "materialize", lambda df, name="table", f=py.materialize: tables.append((name, df.columns)) or f(df, name))
    assert py.score_texts(documents(spark, rows_of())).count() == len(rows_of())
    assert "answers" not in [name for name, _ in tables]
    predicted = [columns for name, columns in tables if name == "predicted"]
    assert len(predicted) == py.ORDER * (1 + py.BURN_IN + py.SAMPLES)
    assert ["p" in columns for columns in predicted[py.ORDER - 1::py.ORDER]] == [False] * (1 + py.BURN_IN) + [True] * py.SAMPLES


def test_no_rows_and_no_training_rows(spark):
    assert py.score_texts(documents(spark, [(1, "a")]).limit(0)).collect() == []
    out = next(i for i in range(100) if held_out(i))
    (r,) = py.score_texts(documents(spark, [(out, "Ab")])).collect()
    assert tuple(r)[:6] == (out, True, 2, 0, 0, pytest.approx(0)) and r.score == pytest.approx(-4 * math.log10(256))


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (py.unpack(py.pack(keys)) == keys).all()
    assert (py.unpack_values(py.pack_values(keys.astype(np.float32)), np.float32) == keys.astype(np.float32)).all()
