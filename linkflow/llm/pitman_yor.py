"""LM scoring by a hierarchical Pitman-Yor model of bytes, seated by Gibbs sampling.

A text is its words in lower case (A-Z), each followed by a space, and an end. The model gives
each byte a probability in the context of the ``ORDER - 1`` bytes before it (across words;
before the text: ends). Every context is a restaurant, whose customers are the bytes seen
after it; its parent is the context without its oldest byte, and the restaurants of contexts
that differ only in that byte share the parent. Each table of a restaurant is one customer of
the parent; the parent of the empty context is the uniform distribution over 256 bytes. With c
customers and t tables of a byte, C and T of the restaurant, discount d and concentration
``STRENGTH``:

    P(byte | context) = (c - d t) / (C + STRENGTH) + (STRENGTH + d T) / (C + STRENGTH) * P(byte | shorter context)

Bytes as dishes leave no word unknown, make keys exact (a gram is one number) and keep every
restaurant within 256 dishes, so none is too large for a task however large the corpus.

Seating. A sweep goes up from the longest contexts: the customers of each dish are taken out
and seated again one after another, at an old table or a new one by the predictive rule, given
the restaurant's other tables and the parent's current probability (``reseated``; beyond
``STEADY`` customers the chance of a new table is held for runs of a ``STEADY``-th of those
seated, at every size alike); the tables are then the parents' customers. Going down, the
predictive probabilities follow from the shortest context to the longest. All dishes of a
level are drawn at once, each given the others' tables of the sweep before. Draws come from
a hash of gram, sweep and step, so a retried task draws the same. The probabilities of the
last ``SAMPLES`` sweeps are averaged, and a text's score is the sum of their logarithms.

On Spark: texts are dealt into slabs by a hash; a slab sends each of its distinct words and
grams once, packed and sorted by bucket of a hash. Counts of all training texts come from the
buckets, and values go back the same way. Nothing of the corpus goes through the driver but
sums. A frequent word or gram has one entry a slab, whatever its count.

Defined cases: null, empty and blank texts are the end alone; a null doc_id is never held out;
repeated rows count as often as they occur; without any training text all probabilities are
uniform and N and V are 0; other columns are ignored. A text is held whole by its task (about
100 bytes of memory a byte of text). Words are counted by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkflow.llm.words import mix64, slices, text_buffers, word_table
from linkflow.session import materialize

ORDER = 6                      # bytes of a gram: 5 of context, 1 seen
BURN_IN, SAMPLES = 1, 2        # sweeps dropped, and averaged
STRENGTH = 1.0
STEADY = 32
SYMBOLS = 256
SPACE, END = 0x20, 0x0A        # no word holds either byte
END_WORD = (1 << 64) - 1       # stands for the end among the words' hashes
PRIOR = 0.1                    # of the base score
SLAB_BYTES, LEAST_BYTES = 16 << 20, 2 << 20
SLICE = 2 << 20
WORDS, GRAMS = 0, 1


def held_out(doc_id="doc_id") -> Column:
    """crc32 of the id as text leaves no remainder by 10."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def read_texts(raw: np.ndarray, off: np.ndarray, cache: dict):
    """(word hashes, their rows, grams, their rows) of the rows whose byte offsets are given."""
    lo, hi = int(off[0]), int(off[-1])
    data = raw[lo:hi]
    data = data + (((data >= 65) & (data <= 90)) * np.uint8(32)).astype(np.uint8)
    starts, ends, row, h = word_table(data, off - lo, cache)
    n, size, pad = len(off) - 1, ends - starts, ORDER - 1
    first = np.cumsum(size + 1) - (size + 1) + (row + 1) * pad + row       # where each word begins in the padded bytes
    out = np.full(int(size.sum()) + len(size) + n * (pad + 1), END, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(first, size) + inner] = data[np.repeat(starts, size) + inner]
    out[first + size] = SPACE
    length = np.bincount(row, size + 1, n).astype(np.int64) + 1             # bytes of each row, with its end
    wide, gram = out.astype(np.uint64), np.zeros(len(out), np.uint64)
    for k in range(ORDER):
        gram[k:] |= wide[:len(out) - k] << np.uint64(8 * k)
    real = np.ones(len(out), bool)
    begin = np.cumsum(length + pad) - (length + pad)
    real[(begin[:, None] + np.arange(pad)).ravel()] = False
    return h, row, gram[real], np.repeat(np.arange(n), length)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as the byte planes of their steps."""
    return zstandard.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_values(values: np.ndarray) -> bytes:
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def unpack_values(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    code, found = pd.factorize(np.concatenate(keys))
    total = np.bincount(code, np.concatenate(counts), len(found)).astype(np.int64)
    order = np.argsort(found)
    return found[order], total[order]


def _slab_entries(buckets: int):
    """(kind, bucket, slab, keys, counts): a slab's distinct words and grams, with their counts in training texts."""
    names = ["kind", "bucket", "slab", "keys", "counts"]

    def run(batches):
        cache: dict = {}
        held: dict = {}

        def add(slab, kind, keys, train):
            code, found = pd.factorize(keys)
            lists = held.setdefault((slab, kind), ([], []))
            lists[0].append(found)
            lists[1].append(np.bincount(code, train, len(found)))
            if sum(map(len, lists[0])) > 4 << 20:
                lists[0][:], lists[1][:] = [[x] for x in _summed(*lists)]

        for b in batches:
            raw, off = text_buffers(b.column(2))
            slab, train = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            edges = np.flatnonzero(np.diff(slab)) + 1                       # a batch may hold more than one slab
            for i, j in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(slab)]])):
                for x, y in slices(off[i:j + 1], SLICE):
                    x, y = x + i, y + i
                    h, row, gram, at = read_texts(raw, off[x:y + 1], cache)
                    own = train[x:y]
                    add(int(slab[i]), WORDS, np.concatenate([h, np.full(y - x, END_WORD, np.uint64)]), np.concatenate([own[row], own]))
                    add(int(slab[i]), GRAMS, gram, own[at])
        for (s, kind), lists in held.items():
            keys, counts = _summed(*lists)
            bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for i in range(0, len(cut) - 1, 256):
                part = [(int(a), int(z)) for a, z in zip(cut[i:i + 256], cut[i + 1:i + 257])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(part), pa.int32()), pa.array([int(bucket[a]) for a, _ in part], pa.int32()),
                    pa.array([s] * len(part), pa.int32()), pa.array([pack(keys[a:z]) for a, z in part], pa.binary()),
                    pa.array([pack_values(counts[a:z]) for a, z in part], pa.binary())], names=names)

    return run


def _bucket_counts(batches):
    """(kind, bucket, key, n) from the slabs' entries, sorted by kind and bucket."""
    names = ["kind", "bucket", "key", "n"]

    def done(at, keys, counts):
        keys, counts = _summed(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), at[0], np.int32)), pa.array(np.full(len(keys), at[1], np.int32)),
                                           pa.array(keys.view(np.int64)), pa.array(counts)], names=names)

    now, keys, counts = None, [], []
    for b in batches:
        for kind, bucket, k, c in zip(*(col.to_pylist() for col in b.columns)):
            if (kind, bucket) != now:
                if keys:
                    yield done(now, keys, counts)
                now, keys, counts = (kind, bucket), [], []
            keys.append(unpack(k))
            counts.append(unpack_values(c, np.int64))
    if keys:
        yield done(now, keys, counts)


# ----------------------------------------------------------------------- seating

def uniform(key: np.ndarray, salt: int, step: int) -> np.ndarray:
    """A number in [0, 1) for each gram, from a hash of gram, sweep and level, and step."""
    x = mix64(key.astype(np.uint64) ^ mix64(np.array([salt * 1_000_003 + step + 1], np.uint64)))
    return (mix64(x) >> np.uint64(11)).astype(float) * 2.0 ** -53


def reseated(key: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, salt: int,
             strength: float = STRENGTH) -> np.ndarray:
    """Tables of each dish after all its customers have been seated again, beside ``others`` tables."""
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated, step = np.ones(len(at), np.int64), 0
    while len(at):
        run = np.minimum(np.maximum(seated // STEADY, 1), customers[at] - seated)
        new = (strength + discount * (others[at] + tables[at])) * parent[at]
        chance = new / (new + seated - discount * tables[at])
        tables[at] += np.minimum(np.floor(run * chance + uniform(key[at], salt, step)).astype(np.int64), run)
        seated, step = seated + run, step + 1
        left = seated < customers[at]
        at, seated = at[left], seated[left]
    return tables


def _shorter(level: int) -> Column:
    """The gram of one byte less of context."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * (level - 1)) - 1))


def _reseat(level: int, sweep: int, discount: float):
    def run(batches):
        for b in batches:
            key, c, t, whole, parent = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            new = reseated(key, c, whole - t, parent, discount, 16 * sweep + level)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new)], names=["key", "c", "t"])

    return run


def _predicted(rows: DataFrame, parents: DataFrame | None, level: int, discount: float) -> DataFrame:
    """(key, c, t, whole, parent, p): the restaurant's tables, the parent's and the own probability."""
    dishes = Window.partitionBy(F.shiftright("key", 8))                     # at most 256 rows
    rows = rows.select("key", "c", "t", F.sum("c").over(dishes).alias("all"), F.sum("t").over(dishes).alias("whole"))
    if parents is None:
        rows = rows.withColumn("parent", F.lit(1.0 / SYMBOLS))
    else:
        rows = (rows.withColumn("short", _shorter(level))
                .join(parents.select(F.col("key").alias("short"), F.col("p").alias("parent")), "short"))
    own = ((F.col("c") - discount * F.col("t")) + (STRENGTH + discount * F.col("whole")) * F.col("parent")) / (F.col("all") + STRENGTH)
    return rows.select("key", "c", "t", "whole", "parent", F.when(F.col("all") > 0, own).otherwise(F.col("parent")).alias("p"))


def _customers(children: DataFrame, level: int) -> DataFrame:
    """Customers of the level below ``level``: the tables of its dishes."""
    return children.groupBy(_shorter(level).alias("key")).agg(F.sum("t").alias("c"))


def discounts(levels: dict[int, DataFrame]) -> dict[int, float]:
    """n1 / (n1 + 2 n2) of each level's counts, within 0.05 and 0.95."""
    out = {}
    for level, rows in levels.items():
        ones, twos = rows.agg(F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
        out[level] = min(max(ones / max(1, ones + 2 * twos), 0.05), 0.95)
    return out


def samples(grams: DataFrame, burn_in: int = BURN_IN, kept: int = SAMPLES):
    """Yield (levels, discounts) of each kept sweep: {level: (key, c, t, whole, parent, p)}, written.

    ``grams``: (key, c) of all grams to be given a probability, c = 0 for those never trained on.
    """
    rows = {ORDER: materialize(grams.select("key", "c", F.least("c", F.lit(1)).cast("long").alias("t")), "grams")}
    for level in range(ORDER, 1, -1):
        fewer = _customers(rows[level], level)
        rows[level - 1] = materialize(fewer.select("key", "c", F.least("c", F.lit(1)).cast("long").alias("t")), "grams")
    discount = discounts(rows)

    def down(rows, used):
        state = {}
        for level in range(1, ORDER + 1):
            found = _predicted(rows[level], state.get(level - 1), level, discount[level])
            state[level] = materialize(found if used or level < ORDER else found.drop("p"), "predicted")   # no level reads that p
        return state

    state = down(rows, False)
    for sweep in range(burn_in + kept):
        rows = {}
        for level in range(ORDER, 0, -1):
            old = state[level]
            if level < ORDER:
                old = old.drop("c").join(_customers(rows[level + 1], level + 1), "key")
            rows[level] = materialize(old.select("key", "c", "t", "whole", "parent").mapInArrow(
                _reseat(level, sweep, discount[level]), "key long, c long, t long"), "seated")
        state = down(rows, sweep >= burn_in)
        if sweep >= burn_in:
            yield state, discount


def averaged(grams: DataFrame, burn_in: int = BURN_IN, kept: int = SAMPLES) -> DataFrame:
    """(key, p): the mean predictive probability of the kept sweeps."""
    total = None
    for state, _ in samples(grams, burn_in, kept):
        p = state[ORDER].select("key", "p")
        total = p if total is None else total.join(p.withColumnRenamed("p", "more"), "key").select("key", (F.col("p") + F.col("more")).alias("p"))
    return total.select("key", (F.col("p") / kept).alias("p"))


# ----------------------------------------------------------------------- scoring

def _answers(batches):
    """(slab, kind, keys, values): each slab's entries with their values, from rows sorted by kind, bucket, side."""
    names = ["slab", "side", "kind", "keys", "values"]
    now, keys, values, index = None, [], [], None
    for b in batches:
        kinds, buckets, slabs = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        key, value = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(buckets) != 0)) + 1
        out: list[list] = [[], [], [], []]
        for i, j in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(kinds)]])):
            i, j = int(i), int(j)
            if i == j:
                continue
            if (kinds[i], buckets[i]) != now:
                now, keys, values, index = (kinds[i], buckets[i]), [], [], None
            mine = slabs[i:j] < 0
            keys.append(key[i:j][mine].astype(np.int64).view(np.uint64))
            values.append(value[i:j][mine])
            for k in np.flatnonzero(~mine) + i:
                if index is None:
                    index, values = pd.Index(np.concatenate(keys)), [np.concatenate(values)]
                data = b.column(5)[int(k)].as_py()
                out[0].append(int(slabs[k]))
                out[1].append(int(now[0]))
                out[2].append(data)
                out[3].append(pack_values(values[0][index.get_indexer(unpack(data))].astype(np.float64 if now[0] == WORDS else np.float32)))
        yield pa.RecordBatch.from_arrays([
            pa.array(out[0], pa.int32()), pa.array([0] * len(out[0]), pa.int32()), pa.array(out[1], pa.int32()),
            pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=names)


def _scored(n_tokens: int, n_types: int):
    """Scores of a slab's texts, from rows sorted by side: its words' and grams' values first."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    floor = n_tokens + PRIOR * (n_types + 1)

    def run(batches):
        cache: dict = {}
        held: dict = {WORDS: ([], []), GRAMS: ([], [])}
        found: dict = {}
        for b in batches:
            side = b.column(0).to_numpy()
            for k in np.flatnonzero(side == 0):
                kind = b.column(1)[int(k)].as_py()
                held[kind][0].append(unpack(b.column(2)[int(k)].as_py()))
                held[kind][1].append(unpack_values(b.column(3)[int(k)].as_py(), np.float64 if kind == WORDS else np.float32))
            docs = b.slice(int((side == 0).sum()))
            if not docs.num_rows:
                continue
            if not found:
                for kind, (keys, values) in held.items():
                    found[kind] = pd.Index(np.concatenate(keys)), np.concatenate(values).astype(float)
                held.clear()
            raw, off = text_buffers(docs.column(6))
            (words, count), (grams, p) = found[WORDS], found[GRAMS]
            ends = float(count[words.get_indexer(np.array([END_WORD], np.uint64))][0])
            log_p = np.log10(p)
            for i, j in slices(off, SLICE):
                h, row, gram, at = read_texts(raw, off[i:j + 1], cache)
                n = j - i
                c = count[words.get_indexer(h)]
                base = np.bincount(row, np.log10((c + PRIOR) / floor), n) + np.log10((ends + PRIOR) / floor)
                yield pa.RecordBatch.from_arrays([
                    docs.column(4).slice(i, n), docs.column(5).slice(i, n), pa.array(np.bincount(row, minlength=n) + 1),
                    pa.array((np.bincount(row, c > 0, n) + (ends > 0)).astype(np.int64)), pa.array(base),
                    pa.array(np.bincount(at, log_p[grams.get_indexer(gram)], n))], names=names)

    return run


def score_texts(docs: DataFrame, out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    ``out``: which rows are not learned from (``held_out`` if not given); perplexity is by token.
    """
    spark = docs.sparkSession
    out = held_out() if out is None else out
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slabs = max(1, -(-size // SLAB_BYTES), min(parts, -(-size // LEAST_BYTES)))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slabs)).cast("int").alias("slab"), out.alias("held_out"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = materialize(rows.select("slab", ~F.col("held_out"), "text").repartitionById(slabs, "slab").mapInArrow(
        _slab_entries(slabs), "kind int, bucket int, slab int, keys binary, counts binary"), "entries")
    counts = materialize(entries.select("kind", "bucket", "keys", "counts").repartition(slabs, "kind", "bucket")
                         .sortWithinPartitions("kind", "bucket").mapInArrow(_bucket_counts, "kind int, bucket int, key long, n long"), "counts")
    words, grams = counts.where(F.col("kind") == WORDS), counts.where(F.col("kind") == GRAMS)
    n_tokens, n_types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    mean = averaged(grams.select("key", F.col("n").alias("c")))
    values = words.select("kind", "bucket", "key", F.col("n").cast("double").alias("value")).unionByName(
        grams.select("kind", "bucket", "key").join(mean.withColumnRenamed("p", "value"), "key"))
    asked = values.select("kind", "bucket", F.lit(-1).alias("slab"), "key", "value", F.lit(None).cast("binary").alias("keys")).unionByName(
        entries.select("kind", "bucket", "slab", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "keys"))
    answers = (asked.repartition(slabs, "kind", "bucket").sortWithinPartitions("kind", "bucket", "slab")   # read once, so not written first
               .mapInArrow(_answers, "slab int, side int, kind int, keys binary, values binary"))
    none = F.lit(None)
    sides = answers.select("slab", "side", "kind", "keys", "values", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"),
                           none.cast("string").alias("text")).unionByName(
        rows.select("slab", F.lit(1).alias("side"), F.lit(0).alias("kind"), none.cast("binary").alias("keys"), none.cast("binary").alias("values"),
                    "doc_id", "held_out", "text"))
    scored = sides.repartitionById(slabs, "slab").sortWithinPartitions("side").select(
        "side", "kind", "keys", "values", "doc_id", "held_out", "text").mapInArrow(
        _scored(n_tokens, n_types), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
                         F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
