"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

Each direction keeps a state of ``HIDDEN`` units under one update gate,
``h = h + z * (c - h)`` with ``c = s(x_c + h U_c)`` and ``z = (1 + s(x_z + h U_z)) / 2``, where
x comes from a table with a row per byte and ``s(a) = a / (1 + |a|)`` bounds the units. The two states at a byte give the language
probabilities of that position; a document's probabilities are their mean over all its
bytes. The network is trained by backpropagation through time (Adam) on a bounded
sample of whole texts: at most ``PER_LANG`` rows of each language, the first by a hash of doc_id, and
``MAX_SAMPLE`` in all. Rows with crc32(doc_id as text) mod 5 = 0 are held out.

Prediction covers whole texts. A text is cut every ``STEP`` bytes; the states of a piece
start ``CONTEXT`` bytes outside it on either side, so every position is labelled with
context, a text's label does not depend on its neighbours in a batch, and memory is bounded
by the slice at hand. The trained weights are a few kilobytes in the task's closure.

Defined cases: null text, empty text and texts without a letter are ``und`` with score 0;
so is every text if there is nothing to learn from. A null doc_id is not held out and not
learned from. Equal texts get equal labels; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkflow.llm.words import slices, text_buffers
from linkflow.llm.workers import map_batches

HIDDEN = 8
STEP, CONTEXT = 256, 16
PER_LANG, MAX_SAMPLE = 400, 20_000      # bounds of the training sample, in rows
PIECE = 96                              # bytes that one step of training reads, anywhere in a sampled text
ROUNDS, BATCH, RATE = 200, 192, 0.03
SLICE = 448 << 10                       # bytes of text predicted at once
PAD = 256
UNKNOWN = "und"


def held_out(doc_id="doc_id"):
    """crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, whole text) pairs of the bounded sample, in a fixed order.

    Languages are counted first; a language's rows are then held to a share of all hashes that
    leaves about four times as many as wanted, and only those few are ranked. Repeated rows
    count as one.
    """
    known = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
             .where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_SAMPLE).collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * PER_LANG / r["count"])) for r in counts], "lang string, share double")
    hashed = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text")).join(F.broadcast(shares), "lang")   # MAX_SAMPLE rows at most
    near = hashed.where(F.col("h") / 2.0 ** 64 + 0.5 < F.col("share")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    rows = (near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_LANG)
            .orderBy("n", "lang").limit(MAX_SAMPLE).select("lang", "text").collect())
    return [(r["lang"], r["text"].encode("utf-8")) for r in rows]


class Direction:
    """One direction of the network: input tables, recurrent matrices (gate, candidate), output matrix."""

    KEYS = ("Ez", "Ec", "Uz", "Uc", "V")

    def __init__(self, rng, n_langs: int):
        size = {"Ez": (PAD + 1, HIDDEN), "Ec": (PAD + 1, HIDDEN), "Uz": (HIDDEN, HIDDEN), "Uc": (HIDDEN, HIDDEN), "V": (HIDDEN, n_langs)}
        self.p = {k: rng.normal(0, 0.3, size[k]).astype(np.float32) for k in self.KEYS}

    def states(self, x):
        """States after each position of x (time x rows), and what the way back needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        kept = []
        for row in x:
            az, ac = self.p["Ez"][row] + h @ self.p["Uz"], self.p["Ec"][row] + h @ self.p["Uc"]
            dz, dc = 1 / (1 + np.abs(az)), 1 / (1 + np.abs(ac))
            z, c = (0.5 + 0.5 * az * dz) * (row != PAD)[:, None], ac * dc
            kept.append((h, z, c, 0.5 * dz * dz * (row != PAD)[:, None], dc * dc))
            h = h + z * (c - h)
        return kept, h

    def back(self, x, kept, grad_out):
        """Gradients of all but V by backpropagation through time; grad_out[t]: of the state after t."""
        up = np.zeros_like(kept[0][0])
        uz, uc = np.zeros_like(self.p["Uz"]), np.zeros_like(self.p["Uc"])
        all_z, all_c = [None] * len(x), [None] * len(x)
        for t in range(len(x) - 1, -1, -1):
            h, z, c, dz, dc = kept[t]
            up = up + grad_out[t]
            gz, gc = up * (c - h) * dz, up * z * dc
            all_z[t], all_c[t] = gz, gc
            uz += h.T @ gz
            uc += h.T @ gc
            up = up * (1 - z) + gz @ self.p["Uz"].T + gc @ self.p["Uc"].T
        at = x.ravel()
        table = lambda g: np.stack([np.bincount(at, col, PAD + 1) for col in np.concatenate(g).T], 1)
        return [table(all_z), table(all_c), uz, uc]


def train(sample: list[tuple[str, bytes]], rounds: int = ROUNDS, seed: int = 1):
    """(languages, weights) learned from (language, text) pairs; None if there are none.

    A step draws texts, and of each text any ``PIECE`` bytes, so all of every text is learned from.
    """
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y_all = np.array([langs.index(lang) for lang, _ in sample])
    data = np.append(np.frombuffer(b"".join(t for _, t in sample), np.uint8).astype(np.int16), PAD)
    size = np.array([len(t) for _, t in sample])
    begin = np.cumsum(size) - size
    share = np.bincount(y_all, minlength=len(langs))
    draw = (1 / share)[y_all] / len(langs)              # languages are drawn equally often
    both = [Direction(rng, len(langs)), Direction(rng, len(langs))]
    bias = np.zeros(len(langs), np.float32)
    params = [d.p[k] for d in both for k in Direction.KEYS] + [bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        pick = rng.choice(len(sample), min(BATCH, len(sample)), p=draw / draw.sum())
        first = (rng.random(len(pick)) * np.maximum(size[pick] - PIECE + 1, 1)).astype(np.int64)
        at = first + np.arange(PIECE)[:, None]
        x, y = data[np.where(at < size[pick], begin[pick] + at, len(data) - 1)].astype(np.int64), y_all[pick]
        ways = [x, x[::-1]]
        runs = [d.states(w) for d, w in zip(both, ways)]
        after = [np.stack([k[0] for k in kept[1:]] + [last]) for kept, last in runs]
        after[1] = after[1][::-1]                       # time x rows x HIDDEN, in text order
        logits = after[0] @ both[0].p["V"] + after[1] @ both[1].p["V"] + bias
        logits -= logits.max(2, keepdims=True)
        d = np.exp(logits)
        d /= d.sum(2, keepdims=True)
        d[:, np.arange(len(y)), y] -= 1
        d *= ((x != PAD) / max(1, (x != PAD).sum()))[:, :, None]
        grads = []
        for k in (0, 1):
            out = d @ both[k].p["V"].T
            grads += both[k].back(ways[k], runs[k][0], out if k == 0 else out[::-1])
            grads.append(np.einsum("tnh,tnk->hk", after[k], d))
        grads.append(d.sum((0, 1)))
        rate = RATE * min(1.0, 2 * (1 - r / (rounds + 1)))
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** r)) / (np.sqrt(b / (1 - 0.99 ** r)) + 1e-8)
    return langs, params


def position_sums(x: np.ndarray, weights: list[np.ndarray], inner: np.ndarray) -> np.ndarray:
    """Summed language probabilities of the positions ``inner`` (rows x time booleans) of each row."""
    n, steps = x.shape
    *dirs, bias = [weights[:5], weights[5:10], weights[10]]
    cols = np.ascontiguousarray(x.T).astype(np.int64)
    part = np.empty((steps, len(bias), n), np.float32)

    def walk(ez, ec, uz, uc, times):
        ez = ez.copy()
        ez[PAD] = -1e30                                 # shuts the gate
        h = np.zeros((n, HIDDEN), np.float32)
        div = np.empty_like(h)
        for t in times:
            z, c = ez.take(cols[t], axis=0), ec.take(cols[t], axis=0)
            z += h @ uz
            c += h @ uc
            for a in (z, c):
                np.abs(a, out=div)
                np.add(div, 1, out=div)
                np.divide(a, div, out=a)
            c -= h
            z += 1
            z *= c
            z *= 0.5
            h += z
            yield t, h

    for t, h in walk(*dirs[0][:4], range(steps - CONTEXT)):
        if t >= CONTEXT:
            np.dot(dirs[0][4].T, h.T, out=part[t])
    total = np.zeros((len(bias), n), np.float32)
    mask = np.ascontiguousarray(inner.T).astype(np.float32)
    for t, h in walk(*dirs[1][:4], range(steps - 1, CONTEXT - 1, -1)):
        if t < steps - CONTEXT:
            logits = part[t]
            logits += dirs[1][4].T @ h.T
            logits += bias[:, None]
            logits -= logits.max(0)
            np.exp(logits, out=logits)
            logits *= mask[t] / logits.sum(0)
            total += logits
    return total.T


def predict(texts: pa.Array, model) -> tuple[list[str], np.ndarray]:
    """(labels, scores) of a column of texts."""
    raw, off = text_buffers(texts)
    n = len(off) - 1
    labels, scores = np.full(n, UNKNOWN, object), np.zeros(n)
    if model is None:
        return labels.tolist(), scores
    langs, weights = model
    steps = STEP + 2 * CONTEXT
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    for i, j in slices(off, SLICE):
        lo, hi = int(off[i]), int(off[j])
        size = np.diff(off[i:j + 1])
        rows = np.flatnonzero(size)
        if not len(rows):
            continue
        data = np.append(raw[lo:hi].astype(np.int16), PAD).astype(np.int16)
        has = np.logical_or.reduceat(letter[data[:-1]], (off[i:j] - lo)[rows])
        for k in np.flatnonzero(~has):
            a, b = off[i + rows[k]], off[i + rows[k] + 1]
            has[k] = any(c.isalpha() for c in raw[a:b].tobytes().decode("utf-8", "replace"))
        rows = rows[has]
        if not len(rows):
            continue
        pieces = -(-size[rows] // STEP)
        doc = np.repeat(np.arange(len(rows)), pieces)
        begin = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STEP
        probs = np.zeros((len(rows), len(langs)))
        for k in range(0, len(doc), 2048):
            d, s = doc[k:k + 2048], begin[k:k + 2048]
            at = s[:, None] + np.arange(-CONTEXT, STEP + CONTEXT)
            inside = (at >= 0) & (at < size[rows[d]][:, None])
            x = data[np.where(inside, at + (off[i + rows[d]] - lo)[:, None], hi - lo)]
            inside[:, :CONTEXT] = inside[:, -CONTEXT:] = False
            np.add.at(probs, d, position_sums(x, weights, inside))
        probs /= size[rows][:, None]
        best = probs.argmax(1)
        labels[i + rows] = np.array(langs, object)[best]
        scores[i + rows] = np.clip(np.round(probs[np.arange(len(rows)), best], 5), 0, 1)
    return labels.tolist(), scores


def label_documents(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang)."""
    model = model or train(training_sample(docs))

    def run(batches):
        for b in batches:
            labels, scores = predict(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = 0.35, model=None) -> DataFrame:
    """``docs``, all columns, without the rows labelled ``und`` or below the score ``least``."""
    model = model or train(training_sample(docs))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            labels, scores = predict(b.column(at).cast(pa.string()), model)
            yield b.filter(pa.array([lab != UNKNOWN and s >= least for lab, s in zip(labels, scores)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
