"""Document fingerprints: one-permutation MinHash with optimal densification, b-bit packed.

Every five-word shingle of a text is hashed once; the top bits of the hash name a bin and
each bin keeps its smallest hash. An empty bin borrows from the first non-empty bin along
its own sequence of hashed probes (the same sequence for every document, drawn anew for
each attempt), which keeps the collision probability of a bin equal to the Jaccard
similarity. Of each bin the lowest ``BITS`` bits are stored, packed into hex digits; the
likeness of two fingerprints is the share of equal bins with the chance of equal low bits
taken out, ``(share - 2**-BITS) / (1 - 2**-BITS)``, cut to 0..1.

Defined cases: a null text counts as empty; a text without words has the fingerprint ``""``
(likeness 1 to another such text, 0 to any other); a text of 1 to 4 words has one shingle.
Equal texts have equal fingerprints. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.words import mix64, shingles, slices, text_buffers, word_table

BINS = 256                    # a power of two
BITS = 4                      # stored per bin
RANGE_PARTS = 4               # doc_id ranges per shuffle partition, for neighbours
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(table: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a non-empty one; rows x BINS of uint64."""
    n_bins = table.shape[1]
    filled = table != EMPTY
    have = filled.sum(1)
    out = table.copy()
    one = np.flatnonzero(have == 1)
    out[one] = table[one].min(1)[:, None]
    r, b = np.nonzero(~filled & (have > 1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        probe = mix64(b.astype(np.uint64) + np.uint64(n_bins * attempt)).astype(np.int64) & (n_bins - 1)
        hit = filled[r, probe]
        out[r[hit], b[hit]] = table[r[hit], probe[hit]]
        r, b = r[~hit], b[~hit]
    return out


def fingerprints(texts: pa.Array, n_bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """rows x n_bins array of low-order bits (uint8); a row without words is all 255."""
    raw, off = text_buffers(texts)
    out = np.full((len(off) - 1, n_bins), 255, np.uint8)
    shift = np.uint64(64 - int(np.log2(n_bins)))
    cache: dict = {}
    for i, j in slices(off):
        _, _, doc, h = word_table(raw, off[i:j + 1], cache)
        sh, so = shingles(h, np.bincount(doc, minlength=j - i))
        if not len(sh):
            continue
        row = np.repeat(np.arange(j - i), np.diff(so))
        table = np.full((j - i) * n_bins, EMPTY, np.uint64)
        np.minimum.at(table, row * n_bins + (sh >> shift).astype(np.int64), sh)
        table = densify(table.reshape(j - i, n_bins))
        low = (mix64(table) & np.uint64((1 << bits) - 1)).astype(np.uint8)
        has = np.diff(so) > 0
        out[i:j][has] = low[has]
    return out


def pack(low: np.ndarray, bits: int = BITS) -> list[str]:
    """Packed low-order bits as lowercase hex; the empty string for a row without words."""
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits:]
    packed = np.packbits(planes.reshape(len(low), -1), axis=1)
    return ["" if x[0] == 255 else p.tobytes().hex() for x, p in zip(low, packed)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected likeness of two arrays of fingerprints, row by row."""
    share = (a == b).mean(1)
    chance = 2.0 ** -bits
    est = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    none_a, none_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(none_a | none_b, (none_a & none_b).astype(float), est)


def fingerprint_documents(docs: DataFrame, n_bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint) of every row, in one pass without a shuffle."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pack(fingerprints(b.column(1), n_bins, bits), bits), pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(part, tail, doc_id, text): rows sorted by descending doc_id inside ranges of doc_id.

    Each range ends with a copy (``tail`` = 1) of the first row of the range below it -- the
    last one with the very first row -- so a scan of a partition sees every row's successor
    without the rows of another. Range limits come from a quantile sketch over doc_id alone,
    the copied rows are found by one aggregation with a row per range, and the text is
    shuffled once. Null ids come last; rows of one id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    ranges = RANGE_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    limits = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"]
    limits = sorted(set(limits or []))
    part = F.lit(0)
    if limits:
        part = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < key))
    rows = rows.select(part.alias("part"), key.alias("k"), F.xxhash64("text").alias("th"), "doc_id", "text")
    firsts = sorted((r["part"], r["f"]["k"], ~r["f"]["t"]) for r in
                    rows.groupBy("part").agg(F.max(F.struct("k", F.bitwise_not("th").alias("t"))).alias("f")).collect())
    above = {p: firsts[(i + 1) % len(firsts)][0] for i, (p, _, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(p, k, t, above[p]) for p, k, t in firsts], "hp int, hk long, ht long, above int")
    # at most `ranges` rows, by construction
    is_head = F.col("above").isNotNull()
    marked = rows.join(F.broadcast(heads), (F.col("part") == F.col("hp")) & (F.col("k") == F.col("hk")) & (F.col("th") == F.col("ht")), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    dealt = marked.select(
        F.explode(F.when(is_head, F.array(here, F.struct(F.col("above").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(here))).alias("at"),
        "k", "th", "doc_id", "text")
    return (dealt.select("at.part", "at.tail", "k", "th", "doc_id", "text")
            .repartition(max(1, ranges // RANGE_PARTS), "part")
            .sortWithinPartitions("part", "tail", F.desc("k"), "th")
            .select("part", "tail", "doc_id", "text"))


EDITED_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


def _edited(batch_rows, ahead):
    """Result rows of consecutive rows, given the row after the last one."""
    ids, texts, low = batch_rows
    nxt = texts[1:] + [ahead[0]]
    edits = []
    for t, n in zip(texts, nxt):
        m = len(t) // 3
        edits.append((t[:len(t) - m] + n[:m]).encode("utf-8"))
    low_next = np.concatenate([low[1:], ahead[1][None]])
    low_edit = fingerprints(pa.array(edits, pa.binary()))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
        pa.array(pack(low), pa.string()), pa.array(pack(low_edit), pa.string()),
        pa.array(likeness(low, low_edit)), pa.array(likeness(low, low_next))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness; also to the next text.

    The edited text replaces the last third of the code points by the first ones of the next
    document in descending doc_id order (the first document follows the last). A partition
    is streamed: only one record batch and one pending row are held.
    """
    def run(batches):
        ids, texts, low, part = [], [], np.zeros((0, BINS), np.uint8), None
        for b in batches:
            b_low = fingerprints(b.column(3))
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
            begin = 0
            new_ids, new_texts = [], []
            for i, (p, tail, doc_id, text) in enumerate(rows):
                if tail:
                    if p == part and (ids or new_ids):
                        own = (ids + new_ids, texts + new_texts, np.concatenate([low, b_low[begin:i]]))
                        yield _edited(own, (text, b_low[i]))
                    ids, texts, low, new_ids, new_texts, begin = [], [], low[:0], [], [], i + 1
                    part = None
                else:
                    part = p
                    new_ids.append(doc_id)
                    new_texts.append(text)
            ids, texts, low = ids + new_ids, texts + new_texts, np.concatenate([low, b_low[begin:]])
            if len(ids) > 1:
                yield _edited((ids[:-1], texts[:-1], low[:-1]), (texts[-1], low[-1]))
                ids, texts, low = ids[-1:], texts[-1:], low[-1:]
        assert not ids, "a range must end with the first row of the next"

    return in_descending_order(docs).mapInArrow(run, EDITED_SCHEMA)
