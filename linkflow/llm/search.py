"""Exact top-k search: BM25 over sharded inverted indexes with block-max WAND pruning.

Documents are dealt over shards of bounded size by a hash of their id; a shard's task sorts
its postings by term and document and keeps, for every term and block of ``BLOCK``
documents, where the block's postings lie and the largest impact among them. Queries are
streamed through the shard. For a query, the sum over its terms of weight times block
maximum bounds every score in a block; blocks are evaluated in falling order of the bound,
a few and then twice as many at a time, the k-th best score so far is the threshold, and
evaluation ends at the first block whose bound is below it: no document there can enter.
Numbers of documents, their mean length and document frequencies are counted over the whole
table beforehand, so scores do not depend on the shards and their best k merge exactly.

Terms are words as they stand (runs of bytes other than space and \\x09-\\x0D). Score:
``sum over terms of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 *
(1 - b + b * dl / avgdl))``, qtf and tf counting the term in query and document. Scores are
rounded to 6 places; ties go to the smaller doc_id. Documents that share no term with the
query are not listed.

Document frequencies are counted for terms that may be in a query: a bitmap of fixed size
over the hashes of all query terms drops most others before they are shuffled (clashes keep
some, which the queries never ask for). It is the one thing sent to all tasks,
``BITMAP_BITS`` long whatever the data.

Defined cases: null and blank texts have no terms: as queries they give no rows, as documents
they count in N and the mean length. A null doc_id is no query; as a document it sorts last.
Repeated rows are separate documents; equal rows ask one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkflow.llm.words import mix64, slices, text_buffers, word_table
from linkflow.session import materialize

TOP_K = 10
K1, B = 1.2, 0.75
EVERY = 100                    # rows whose id is divisible by this are the queries
BLOCK = 64                     # documents of a block
DENSE_SHARE = 0.03             # share of a shard's documents that makes a term's row dense
DENSE_CELLS = 8_000_000        # of dense rows in a shard, 64 MB
QUERY_BATCH = 32               # queries of one matrix product
FIRST_BLOCKS = 16              # evaluated before the first threshold
SHARD_WORDS = 12_000_000       # words of the documents of one shard, about
BITMAP_BITS = 1 << 26          # 8 MB
NO_ID = (1 << 63) - 1          # stands for a null doc_id in keys
_BUCKET = 32_768               # bits of one row of Spark's bitmap aggregate


def term_counts(texts: pa.Array):
    """For each slice: (first row, words per row, row, term, count) of the distinct terms of its rows."""
    raw, off = text_buffers(texts)
    cache: dict = {}
    for i, j in slices(off, 1 << 21):
        _, _, doc, h = word_table(raw, off[i:j + 1], cache)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        yield i, np.bincount(doc, minlength=j - i), doc[at], h[at], np.diff(np.append(at, len(h)))


def _slot(term: np.ndarray) -> np.ndarray:
    return (mix64(term) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _wanted(term: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = _slot(term)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def _query_terms(queries: DataFrame) -> DataFrame:
    """(k, tag, term, qtf, slot) of every distinct term of every query."""
    names = ["k", "tag", "term", "qtf", "slot"]

    def run(batches):
        for b in batches:
            for i, _, row, term, count in term_counts(b.column(2)):
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(term.view(np.int64)),
                                                  pa.array(count), pa.array(_slot(term))], names=names)

    return queries.select("k", "tag", "text").mapInArrow(run, "k long, tag long, term long, qtf long, slot long")


def _query_bitmap(terms: DataFrame) -> bytes:
    """The bitmap of the query terms' slots: BITMAP_BITS bits, put together from fixed rows."""
    slots = terms.select("slot").distinct()
    rows = (slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())   # BITMAP_BITS / 8 bytes at most
    out = np.zeros(BITMAP_BITS // 8 + 2 * _BUCKET // 8, np.uint8)
    for r in rows:   # bucket n holds values (n - 1) * 32768 + 1 .. n * 32768, at bit 0 up
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        values = np.flatnonzero(bits) + (r["bucket"] - 1) * _BUCKET + 1 if r["bucket"] > 0 else np.flatnonzero(bits) * -1
        np.bitwise_or.at(out, values >> 3, (1 << (values & 7)).astype(np.uint8))
    return out[:BITMAP_BITS // 8].tobytes()


def _corpus_counts(rows: DataFrame, bitmap) -> DataFrame:
    """(kind, term, n): document frequencies (kind 0), number of documents (1) and of words (2)."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            terms, words = [np.zeros(0, np.uint64)], 0
            for _, size, _, term, _ in term_counts(b.column(0)):
                terms.append(term[_wanted(term, bits)])
                words += int(size.sum())
            term, n = np.unique(np.concatenate(terms), return_counts=True)
            kind = np.concatenate([np.zeros(len(term), np.int32), [1, 2]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(kind), pa.array(np.concatenate([term.view(np.int64), [0, 0]])),
                pa.array(np.concatenate([n, [b.num_rows, words]]).astype(np.int64))], names=["kind", "term", "n"])

    return rows.select("text").mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _postings(rows: DataFrame) -> DataFrame:
    """(k, tag, dl, terms, vals): each document's terms in order and their counts, packed, and its length."""
    def run(batches):
        for b in batches:
            for i, size, row, term, count in term_counts(b.column(2)):
                ends = np.searchsorted(row, np.arange(len(size) + 1))
                pack = lambda a, w: pa.Array.from_buffers(pa.binary(), len(size), [
                    None, pa.py_buffer((ends * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a))])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, len(size)), b.column(1).slice(i, len(size)), pa.array(size.astype(np.int64)),
                    pack(term, 8), pack(count.astype(np.uint32), 4)], names=["k", "tag", "dl", "terms", "vals"])

    return rows.select("k", "tag", "text").mapInArrow(run, "k long, tag long, dl long, terms binary, vals binary")


def _documents(b: pa.RecordBatch, i: int, j: int):
    """(ids, lengths, terms per document, terms, counts) of rows ``i`` to ``j`` of a batch, copied out of it."""
    (terms, off), (counts, count_off) = text_buffers(b.column(5)), text_buffers(b.column(6))
    return (b.column(2).to_numpy()[i:j].copy(), b.column(4).to_numpy()[i:j].copy(), np.diff(off[i:j + 1]) // 8,
            terms[off[i]:off[j]].view(np.uint64).copy(), counts[count_off[i]:count_off[j]].view(np.uint32).copy())


_NO_DOCUMENTS = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint32))


def _lead(size: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent term of each document, the first if there are several (0 if it has none)."""
    lead = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        start = (np.cumsum(size) - size)[some]
        most = np.flatnonzero(counts == np.repeat(np.maximum.reduceat(counts, start), size[some]))
        lead[some] = terms[most[np.searchsorted(most, start)]]
    return lead


def _by_term(parts: list, place: np.ndarray, norm: np.ndarray):
    """(terms, documents per term, place, impact) of the parts' postings, sorted by term and place.

    One sixteenth of the terms is sorted at a time, so sorting takes little room beside the result.
    """
    postings = sum(len(p[3]) for p in parts)
    sorted_place, impact = np.empty(postings, np.int32), np.empty(postings)
    terms, df, done = [], [], 0
    for sixteenth in range(16):
        t, f, d, before = [], [], [], 0
        for _, _, size, term, count in parts:
            at = np.flatnonzero(term.view(np.uint8)[7::8] >> 4 == sixteenth)   # the highest bits of each little-endian term
            t.append(term[at])
            f.append(count[at])
            d.append(place[before + np.searchsorted(np.cumsum(size), at, side="right")])
            before += len(size)
        t, f, d = np.concatenate(t), np.concatenate(f), np.concatenate(d)
        order = np.lexsort((d, t))
        t, f, d = t[order], f[order], d[order]
        sorted_place[done:done + len(d)] = d
        impact[done:done + len(d)] = f * (K1 + 1) / (f + norm[d])
        done += len(d)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[:len(t)])
        terms.append(t[first])
        df.append(np.diff(np.append(first, len(t))))
    return np.concatenate(terms), np.concatenate(df), sorted_place, impact


class ShardIndex:
    """Inverted index of one shard: postings by term and document, with block maxima.

    Documents get neighbouring places if they share their most frequent term and are of
    similar length, which keeps block maxima close to the impacts under them. Rows of the
    terms with most postings are kept dense, at most ``DENSE_CELLS`` in all: their part of
    the scores of a batch of queries is one matrix product, and its exact maximum in a block
    takes the place of those terms' block maxima. The list of parts given is emptied.
    """

    def __init__(self, parts: list, mean_length: float):
        ids, lengths, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
        n = len(ids)
        order = np.lexsort((ids, lengths, np.concatenate([_lead(*p[2:]) for p in parts])))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.ids = ids[order]
        norm = K1 * (1 - B + B * lengths[order].astype(np.float64) / max(mean_length, 1e-9))
        self.terms, df, self.doc, self.impact = _by_term(parts, place, norm)
        parts.clear()
        self.blocks = -(-n // BLOCK)
        common = np.sort(np.argsort(-df, kind="stable")[:DENSE_CELLS // max(1, n)])
        common = common[df[common] >= n * DENSE_SHARE]
        self.dense_at = np.full(len(df), -1, np.int64)
        self.dense_at[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        start = np.concatenate([[0], np.cumsum(df)])
        for row, t in enumerate(common):
            at = slice(start[t], start[t + 1])
            self.dense[row, self.doc[at]] = self.impact[at]
        rare = np.repeat(self.dense_at < 0, df)
        self.doc = self.doc[rare]
        self.impact = self.impact[rare]
        start = np.concatenate([[0], np.cumsum(np.where(self.dense_at < 0, df, 0))])
        block = self.doc // BLOCK
        new = np.ones(len(block), bool)
        new[1:] = block[1:] != block[:-1]
        new[start[start < len(block)]] = True
        begin = np.flatnonzero(new)                           # one entry per term and block
        self.block = block[begin]
        del rare, block, new
        self.top = np.maximum.reduceat(self.impact, begin, dtype=np.float32) if len(begin) else np.zeros(0, np.float32)
        np.nextafter(self.top, np.float32(np.inf), out=self.top)
        self.entry = np.searchsorted(begin, start)
        self.begin = np.append(begin.astype(np.int32), np.int32(len(self.doc)))

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
        """For each query (terms, weights): (row numbers, scores) of its k best documents and all ties with the last."""
        if not len(self.ids) or not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        weights = np.zeros((len(queries), len(self.dense)))
        rest = []
        for q, (terms, w) in enumerate(queries):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            here = self.terms[at] == terms
            at, w = at[here], w[here]
            row = self.dense_at[at]
            weights[q, row[row >= 0]] = w[row >= 0]
            rest.append((at[row < 0], w[row < 0]))
        return [self._best(part, *r, k) for part, r in zip(weights @ self.dense, rest)]

    def _best(self, part: np.ndarray, at: np.ndarray, weights: np.ndarray, k: int):
        """Block-max WAND for one query: ``part`` has the dense terms' share of every score."""
        size = self.entry[at + 1] - self.entry[at]
        entry = np.arange(size.sum()) + np.repeat(self.entry[at] - np.cumsum(size) + size, size)
        weight = np.repeat(weights, size)
        block = self.block[entry]
        bound = np.bincount(block, weight * self.top[entry], self.blocks) + part.reshape(-1, BLOCK).max(1)
        order = np.argsort(-bound, kind="stable")
        order = order[:int((bound > 0).sum())]
        rows, scores, low = np.zeros(0, np.int64), np.zeros(0), -np.inf
        done, step = 0, FIRST_BLOCKS
        while done < len(order) and bound[order[done]] >= low - 2e-6:
            chosen = np.zeros(self.blocks, bool)
            now = order[done:done + step]
            chosen[now[bound[now] >= low - 2e-6]] = True
            r, s = self._scores(part, entry, weight, chosen[block], chosen)
            rows, scores = np.concatenate([rows, r]), np.concatenate([scores, s])
            if len(scores) >= k:
                low = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= low
                rows, scores = rows[keep], scores[keep]
            done, step = done + step, step * 4
        return rows, scores

    def _scores(self, part: np.ndarray, entry: np.ndarray, weight: np.ndarray, chosen: np.ndarray, blocks: np.ndarray):
        """Exact scores of the documents of the chosen blocks; terms add up in their order."""
        entry, weight = entry[chosen], weight[chosen]
        size = self.begin[entry + 1] - self.begin[entry]
        at = np.arange(size.sum()) + np.repeat(self.begin[entry] - np.cumsum(size) + size, size)
        scores = part + np.bincount(self.doc[at], np.repeat(weight, size) * self.impact[at], len(part))
        scores[~np.repeat(blocks, BLOCK)] = 0
        rows = np.flatnonzero(scores)
        return rows, np.round(scores[rows], 6)


def _searched(dealt: DataFrame, mean_length: float, k: int) -> DataFrame:
    """(q, qtag, k, score): the best of each shard for each query."""
    def run(batches):
        shard, index, held, asked = None, None, [_NO_DOCUMENTS], []

        def answers(out):
            found = index.best([(t, w) for _, _, t, w in asked], k)
            for (q, tag, _, _), (rows, scores) in zip(asked, found):
                cut = np.lexsort((index.ids[rows], -scores))[:k]
                for o, v in zip(out, ([q] * len(cut), [tag] * len(cut), index.ids[rows[cut]].tolist(), scores[cut].tolist())):
                    o += v
            asked.clear()

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                               pa.array(out[3], pa.float64())], names=["q", "qtag", "k", "score"])

        for b in batches:
            out = [[], [], [], []]
            of_shard, kind, i = b.column(0).to_numpy(), b.column(1).to_numpy(), 0
            while i < b.num_rows:
                if of_shard[i] != shard:
                    if asked:
                        answers(out)
                    shard, index, held = of_shard[i], None, [_NO_DOCUMENTS]
                if kind[i] == 0:
                    end = np.flatnonzero((of_shard[i:] != shard) | (kind[i:] != 0))
                    end = i + int(end[0]) if len(end) else b.num_rows
                    held.append(_documents(b, i, end))
                    i = end
                    continue
                if index is None:
                    index = ShardIndex(held, mean_length)
                key, tag, terms, vals = (b.column(c)[i].as_py() for c in (2, 3, 5, 6))
                asked.append((key, tag, np.frombuffer(terms, np.uint64), np.frombuffer(vals, np.float64)))
                if len(asked) == QUERY_BATCH:
                    answers(out)
                i += 1
            yield batch(out)
        out = [[], [], [], []]
        if asked:
            answers(out)
        yield batch(out)

    return dealt.mapInArrow(run, "q long, qtag long, k long, score double")


def _packed_queries(weighted: DataFrame) -> DataFrame:
    """(k, tag, dl, terms, vals) of each query: terms in order with their weights, packed."""
    def run(batches):
        for b in batches:
            terms, vals = [], []
            for pairs in b.column(2).to_pylist():
                t = np.array([p["term"] for p in pairs], np.int64).view(np.uint64)
                w = np.array([p["weight"] for p in pairs], np.float64)
                order = np.argsort(t, kind="stable")
                terms.append(t[order].tobytes())
                vals.append(w[order].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([0] * len(terms), pa.int64()),
                                              pa.array(terms, pa.binary()), pa.array(vals, pa.binary())], names=["k", "tag", "dl", "terms", "vals"])

    lists = weighted.groupBy("k", "tag").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
    return lists.mapInArrow(run, "k long, tag long, dl long, terms binary, vals binary")


def top_documents(docs: DataFrame, queries: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of ``docs`` for every query.

    ``queries`` (doc_id, text) are the rows of ``docs`` whose id is divisible by ``EVERY`` if not given.
    """
    def keyed(df):
        return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("tag"),
                         F.col("text").cast("string").alias("text"))

    spark = docs.sparkSession
    rows = keyed(docs)
    asked = keyed((docs.where(F.col("doc_id") % EVERY == 0) if queries is None else queries).where("doc_id is not null"))
    terms = materialize(_query_terms(asked).dropDuplicates(["k", "tag", "term"]), "query-terms")
    bitmap = spark.sparkContext.broadcast(_query_bitmap(terms))          # of fixed size
    counts = materialize(_corpus_counts(rows, bitmap), "counts")
    total = {r["kind"]: r["n"] for r in counts.where("kind > 0").collect()}   # two rows
    n, words = total.get(1, 0), total.get(2, 0)
    idf = F.log1p((F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighted = terms.join(counts.where("kind = 0").select("term", "n"), "term").select("k", "tag", "term", (F.col("qtf") * idf).alias("weight"))
    shards = max(1, -(-words // SHARD_WORDS))
    of_shard = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int")
    parts = _postings(rows).select(of_shard.alias("shard"), F.lit(0).alias("kind"), "k", "tag", "dl", "terms", "vals")
    asks = _packed_queries(weighted).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
                                            "k", "tag", "dl", "terms", "vals")
    dealt = parts.unionByName(asks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "k")
    found = _searched(dealt, words / n if n else 0.0, k)
    place = Window.partitionBy("q", "qtag").orderBy(F.desc("score"), "k")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), F.col("rank").cast("long").alias("rank"),
                    F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "score"))
