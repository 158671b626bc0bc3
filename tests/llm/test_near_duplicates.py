"""The Jaccard join and its parts against brute force, on the given documents and on one large group."""
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from linkflow.llm import components, mixing, neighbours

SF = "/root/testdata/sf0.01"


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        if w:
            out[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    return out


def true_links(sets, least=0.8):
    """Pairs by an inverted index over shingles."""
    index, links = defaultdict(list), set()
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                shared[j] += 1
            index[s].append(i)
        links |= {(j, i) for j, n in shared.items() if n / (len(sets[i]) + len(sets[j]) - n) >= least}
    return links


def classes_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_links_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    links = true_links(sets_of(rows))
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in neighbours.jaccard_classes(docs).collect()}
    want = {i: (c, count[i]) for i, c in classes_of([i for i, _ in rows], links).items()}
    assert len(links) > 100 and sum(n for _, n in got.values()) >= neighbours.TARGET_RECALL * 2 * len(links)
    assert sum(got[i] == want[i] for i in want) >= neighbours.TARGET_RECALL * len(want)


@pytest.mark.parametrize("block,blob", [(512, 8 << 20), (8, 8 << 20), (512, 20_000)])
def test_one_group_in_many_blocks(spark, monkeypatch, block, blob):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", blob)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):                                  # near copies, with exact ones among them
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(200)] = f"x{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(300 + i, " ".join(f"q{i}_{k}" for k in range(30))) for i in range(30)]
    links = true_links(sets_of(rows))
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in neighbours.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (c, count[i]) for i, c in classes_of([i for i, _ in rows], links).items()}


def test_blocks_report_links_between_groups_only():
    """Two blocks of 50 copies each are one link, not 2,500."""
    rnd = np.random.default_rng(0)
    base = np.sort(rnd.integers(0, 1 << 62, 400).astype(np.uint64))
    rows = []
    for side in (0, 1):
        for i in range(50):
            own = base.copy()
            own[i] = i + 100 * side
            rows.append((b"r", 0, 1, side, bytes([side, i]), 1, bytes([side]), np.sort(own).tobytes()))
    cols = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["root", "i", "j", "side", "g", "copies", "group", "sh"])
    (out,) = list(neighbours._across(0.8)([batch]))
    links = [(a, b) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if b is not None]
    assert links == [(b"\x00", b"\x01")] and sum(out.column(2).to_pylist()) == 2 * 50 * 50


def test_candidates_are_all_pairs_that_share_a_prefix(spark):
    rnd = random.Random(3)
    labels = {bytes([i]): [b"".join(bytes([0, rnd.choice([1, 2])]) for _ in range(neighbours.MAX_DEPTH)) for _ in range(3)] for i in range(90)}
    reps = spark.createDataFrame([(g, ls) for g, ls in labels.items()], "g binary, labels array<binary>").repartition(7)
    depth = 4
    found = [(bytes(r.a), bytes(r.b)) for r in neighbours.candidate_links(reps, depth).collect()]
    assert len(found) < 3 * 90
    wide = [(a, b) for a in labels for b in labels if a < b and any(x[:2 * depth] == y[:2 * depth] for x, y in zip(labels[a], labels[b]))]
    assert classes_of(labels, found) == classes_of(labels, wide)
    for a, b in found:
        assert any(x[:2 * depth] == y[:2 * depth] for x, y in zip(labels[a], labels[b]))


@pytest.mark.parametrize("n,m", [(200, 150), (300, 900), (40, 0)])
def test_components(spark, n, m):
    rnd = random.Random(n)
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1012)]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    want = classes_of(nodes, [(a, b) for a, b in links if a != b])
    assert got == want
    assert components.connected_components(df.limit(0)).collect() == []


def test_clashing_columns_are_kept(spark):
    rows = [(i, "one two three four five six", "s", f"mine{i}", f"key{i}", 7, 8, 9) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy string, mix_key string, k int, th int, n int")
    kept = neighbours.one_of_each_class(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == rows[:1]
    mixed = mixing.poisson_mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy_", "mix_key_"]
    for r in mixed.collect():
        assert tuple(r)[:8] == rows[r.doc_id] and r.mix_copy_ >= 1
