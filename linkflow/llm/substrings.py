"""Substring dedup: words under a 20-word window that also starts earlier, by FM-indexes of shards.

Equal windows have equal minimizers (the smallest of their sixteen five-word hashes, the
first if there are several), so a document's windows are cut into segments -- runs of
consecutive windows with the same minimizer -- and a segment goes to the shard of its
minimizer's hash. All that a window could equal is in that shard; documents never meet
whole. Before any words travel, segments are reduced by hashes:

* minimizers seen once in the corpus cannot repeat and go no further;
* of equal segments only the first (smallest doc_id, then start) can be new; all windows of
  the others start earlier there and are removed. Equal segments of one slice are reduced
  where they are read, so copies do not pile up under one key;
* segments of a minimizer with a single content need no search.

The words of what is left are read from the documents and dealt to shards of bounded size.
Each shard builds a compressed FM-index (wavelet matrix over the BWT of its words) of its
segments and streams the segments through it: backward search gives matching statistics,
and the spans of at least a window that occur earlier are reported. A minimizer with more
than ``HOT`` contents is dealt window by window, by the window's own hash, so no shard
grows with it.

Result per row: doc_id, n_words, n_removed, kept_sha256. Windows are judged on the input.
Defined cases: null and blank texts have no words; texts under 20 words keep all; a null
doc_id counts as larger than any other; rows of one doc_id count as one document, so equal
rows do not remove each other's words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkflow.llm.fm_index import repeated_spans
from linkflow.llm.words import BASE, grams, mix64, powers, slices, text_buffers, word_table
from linkflow.session import materialize

WINDOW = 20                    # words
GRAM = 5                       # words of a minimizer
SPREAD = WINDOW - GRAM + 1     # grams of a window
SHARD_WORDS = 400_000          # aimed at per shard
HOT = 2_000                    # contents of one minimizer dealt together
NO_ID = (1 << 63) - 1          # stands for a null doc_id in keys


def segments(doc: np.ndarray, h: np.ndarray):
    """(first word, windows, minimizer hash, content hash) of every segment of a slice's words."""
    none = np.zeros(0, np.int64)
    g = grams(h, GRAM)
    if len(g) < SPREAD:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    n = len(h) - WINDOW + 1
    best = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, SPREAD)[:n].argmin(1)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    if not len(starts):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    best = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    first, best = starts[at], best[at]
    up, down = powers(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    last = first + count - 1 + WINDOW
    content = mix64((total[last] - total[first]) * down[first] + np.uint64(BASE) * (last - first).astype(np.uint64)
                    + (best - first).astype(np.uint64))
    return first, count, g[best], content


def _anchors(rows: DataFrame) -> DataFrame:
    """One row per segment: (hk, h, ctx, dup, k, p); p packs first word, windows - 1 and the text's tag."""
    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            tags = b.column(1).to_numpy().astype(np.int64)
            raw, off = text_buffers(b.column(2))
            cache: dict = {}
            for i, j in slices(off, 1 << 21):
                _, _, doc, h = word_table(raw, off[i:j + 1], cache)
                first, count, mini, content = segments(doc, h)
                if not len(first):
                    continue
                row = doc[first]
                a = first - np.searchsorted(doc, row)
                k = keys[i:j][row]
                order = np.lexsort((a, k, content, mini))
                a, k, row, count, mini, content = (x[order] for x in (a, k, row, count, mini, content))
                same = np.zeros(len(a), bool)
                same[1:] = (mini[1:] == mini[:-1]) & (content[1:] == content[:-1])
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
                dup = (k != k[lead]) | (a != a[lead])
                p = (a << 36) | ((count - 1) << 32) | tags[i:j][row]
                hk = np.where(dup, mix64(p.view(np.uint64) + mix64(k.view(np.uint64))), mini)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hk.view(np.int64)), pa.array(mini.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(dup), pa.array(k), pa.array(p)], names=["hk", "h", "ctx", "dup", "k", "p"])

    return rows.select("k", "tag", "text").mapInArrow(run, "hk long, h long, ctx long, dup boolean, k long, p long")


def _flagged(rows: DataFrame) -> DataFrame:
    """(k, p, h, hot): segments that start earlier elsewhere (h null), and those to be searched (h set)."""
    same = Window.partitionBy("hk", "ctx").orderBy("k", F.shiftright("p", 36))
    ranked = (_anchors(rows).repartition("hk")
              .withColumn("place", F.rank().over(same)).withColumn("n", F.row_number().over(same)))
    contents = F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).over(Window.partitionBy("hk"))
    ranked = ranked.withColumn("contents", contents)
    known = F.col("dup") | (F.col("place") > 1)
    return (ranked.where(known | (F.col("contents") > 1))
            .select("k", "p", F.when(~known, F.col("h")).alias("h"), (~known & (F.col("contents") > HOT)).alias("hot")))


def _unpack(p: int) -> tuple[int, int, int]:
    """(first word, end word, tag)."""
    first = p >> 36
    return first, first + ((p >> 32) & 15) + WINDOW, p & 0xFFFFFFFF


def _pieces(docs_with_wanted: DataFrame) -> DataFrame:
    """(route, k, tag, a, words) of the wanted segments of each document; hot ones window by window."""
    names = ["route", "k", "tag", "a", "words"]

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for k, tag, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                words = (text or "").encode("utf-8").split()
                for w in wanted:
                    a, e, t = _unpack(w["p"])
                    if t != tag:
                        continue
                    for x, y in ([(i, i + WINDOW) for i in range(a, e - WINDOW + 1)] if w["hot"] else [(a, e)]):
                        piece = b" ".join(words[x:y])
                        route = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True) if w["hot"] else w["h"]
                        for o, v in zip(out, (route, k, tag, x, piece)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=names)

    return docs_with_wanted.mapInArrow(run, "route long, k long, tag long, a long, words binary")


def _search(held: list) -> list[tuple[int, int, int, int]]:
    """(k, tag, first, end) of the spans of the held pieces that occur earlier in their shard."""
    words = [w.split(b" ") for _, _, _, w in held]
    flat = pa.array([x for w in words for x in w], pa.binary())
    symbols = flat.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    cuts = np.cumsum([len(w) for w in words])[:-1]
    ks = np.unique(np.array([k for k, *_ in held], np.int64), return_inverse=True)[1]
    order = [(int(r) << 32) + a + np.arange(len(w)) for r, (_, _, a, _), w in zip(ks, held, words)]
    spans = repeated_spans(np.split(symbols, cuts), order, WINDOW)
    return [(k, t, a + x, a + y) for (k, tags, a, _), found in zip(held, spans) for x, y in found for t in tags]


def _shards(pieces: DataFrame, shards: int) -> DataFrame:
    """Covered spans (k, tag, first, end) found by the shards' indexes."""
    def batch(rows):
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "tag", "first", "end"])

    def run(batches):
        shard, held = None, []
        for b in batches:
            out = []
            for at, k, tag, a, words in zip(*(c.to_pylist() for c in b.columns)):
                if at != shard:
                    if len(held) > 1:
                        out += _search(held)
                    shard, held = at, []
                if held and held[-1][3] == words:          # equal pieces come together, the first one first
                    if (k, a) != (held[-1][0], held[-1][2]):
                        out.append((k, tag, a, a + words.count(b" ") + 1))
                    elif tag not in held[-1][1]:
                        held[-1][1].append(tag)
                else:
                    held.append((k, [tag], a, words))
            yield batch(out)
        if len(held) > 1:
            yield batch(_search(held))

    return (pieces.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
            .repartition(shards, "shard").sortWithinPartitions("shard", "words", "k", "a")
            .select("shard", "k", "tag", "a", "words").mapInArrow(run, "k long, tag long, first long, end long"))


def _kept(joined: DataFrame) -> DataFrame:
    """Result rows of (doc_id, tag, text, spans)."""
    def run(batches):
        for b in batches:
            n_words, n_removed, digests = [], [], []
            for tag, text, spans in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or "").encode("utf-8").split()
                n = len(words)
                gone = np.zeros(n, bool)
                for s in spans or ():
                    if s["tag"] == tag:
                        gone[s["first"]:s["end"]] = True
                if gone.any():
                    words = [w for w, x in zip(words, gone.tolist()) if not x]
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_word_spans(rows: DataFrame) -> DataFrame:
    """(k, tag, first, end): word spans of ``rows`` (k, tag, text) covered by windows that start earlier."""
    flagged = materialize(_flagged(rows), "flagged")
    searched = flagged.where("h is not null")
    size = searched.agg(F.sum(F.shiftright("p", 32).bitwiseAND(15) + WINDOW)).first()[0] or 0
    wanted = searched.groupBy("k").agg(F.collect_list(F.struct("p", "h", "hot")).alias("wanted"))
    pieces = _pieces(rows.join(wanted, "k").select("k", "tag", "text", "wanted"))
    found = _shards(pieces, max(1, -(-size // SHARD_WORDS)))
    first = F.shiftright("p", 36)
    known = flagged.where("h is null").select(
        "k", F.col("p").bitwiseAND(0xFFFFFFFF).alias("tag"), first.alias("first"),
        (first + F.shiftright("p", 32).bitwiseAND(15) + WINDOW).alias("end"))
    return known.unionByName(found)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
                       F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("tag"), F.col("text").cast("string").alias("text"))
    spans = (repeated_word_spans(rows.select("k", "tag", "text")).groupBy("k")
             .agg(F.collect_list(F.struct("tag", "first", "end")).alias("spans")))
    return _kept(rows.join(spans, "k", "left").select("doc_id", "tag", "text", "spans"))
