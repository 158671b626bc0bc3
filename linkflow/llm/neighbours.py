"""N-gram Jaccard join: MinHash LSH forest, exact verification, classes and link counts.

Every document's five-word shingles give ``TREES`` labels of ``MAX_DEPTH`` MinHash values each. A
tree of the forest is the prefix trie of its labels, kept as the sorted labels: rows that share a
prefix stand beside each other. Each row is linked to its neighbour at the longest prefix the
two share; that prefix is shortened from ``MAX_DEPTH`` no further than to the depth at which
``1 - (1 - s**depth) ** TREES`` -- the chance that a pair at the threshold similarity s meets in
some tree -- reaches the target recall (``forest_depth``). Neighbours that share less are not
linked. A node of n rows makes n - 1 candidate links in this way, never n * n. Labels are sorted
by a range partitioning over tree, label and row, so a prefix that many rows share is dealt over
tasks; the rows at the partitions' edges are compared apart.

Verification is exact: documents of one candidate component compare their whole shingle
sets, block by block (at most about ``BLOCK`` documents and ``BLOCK_BYTES`` of sets a side), so a
large component is dealt over many tasks. A block is compared with itself first, which gives
its linked groups; two blocks then report the linked copies of each document and links between
their groups only, at most one fewer than there are groups. Within a task one document at a
time is compared with all others at once; where the triangle inequality of the Jaccard distance
already proves every remaining pair linked, the comparison is skipped.

Result, one row per input row: doc_id, class_id (smallest doc_id of all documents joined
by links), n_links (other rows whose similarity to this one is at least the threshold).
Documents with equal shingle sets (copies) are linked to each other and share links.

Defined cases: null, empty and blank texts have no shingles: their class is their own
doc_id and they have no links. A text of 1 to 4 words has one shingle, all its words. A
null doc_id counts as larger than any other. Repeated rows are copies of each other.
Other columns are ignored, or kept as they are where rows are returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkflow.llm.components import connected_components
from linkflow.llm.words import mix64, shingles, slices, text_buffers, word_table
from linkflow.llm.workers import map_batches
from linkflow.session import materialize

THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 8
TARGET_RECALL = 0.995         # of pairs exactly at the threshold; higher above it
NO_ID = (1 << 63) - 1          # stands for a null doc_id in keys
BLOCK = 512                   # documents on one side of a verification task
BLOCK_BYTES = 8 << 20         # and bytes of their shingle sets
VALUE_BYTES = 2               # of one MinHash value in a label


def forest_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = MAX_DEPTH,
                 target: float = TARGET_RECALL) -> int:
    """Shorten the matched prefix from ``deepest`` until the target recall is met."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def labels(sh: np.ndarray, off: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """rows x trees x depth array of 16-bit MinHash values, big-endian so that bytes sort like values.

    Rows must have shingles.
    """
    out = np.zeros((len(off) - 1, trees, depth), ">u2")
    low = (sh & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (sh >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for t in range(trees):
        for d in range(depth):
            k = t * MAX_DEPTH + d + 1
            a = np.uint32(int(mix64(np.array([k], np.uint64))[0]) & 0xFFFFFFFF | 1)
            v = low * a + high * np.uint32(k)
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(13)
            least = np.minimum.reduceat(v, off[:-1])
            out[:, t, d] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingles, offsets) of the rows that have shingles, slice by slice."""
    raw, off = text_buffers(texts)
    cache: dict = {}
    for i, j in slices(off):
        _, _, doc, h = word_table(raw, off[i:j + 1], cache)
        sh, so = shingles(h, np.bincount(doc, minlength=j - i))
        row = np.repeat(np.arange(j - i), np.diff(so))
        order = np.lexsort((sh, row))
        sh, row = sh[order], row[order]
        keep = np.ones(len(sh), bool)
        keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
        sh, row = sh[keep], row[keep]
        have, size = np.unique(row, return_counts=True)
        yield have + i, sh, np.concatenate([[0], np.cumsum(size)])


def _signed(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(doc_id, th, g, size, labels): set digest g, shingles and labels of every row that has shingles."""
    def run(batches):
        for b in batches:
            for rows, sh, off in _shingle_sets(b.column(2)):
                if not len(rows):
                    continue
                take = pa.array(rows)
                one = np.add.reduceat(mix64(sh), off[:-1])
                two = mix64(np.bitwise_xor.reduceat(mix64(sh + np.uint64(77)), off[:-1]) + np.diff(off).astype(np.uint64))
                g = np.stack([one, two], 1).astype(">u8").tobytes()
                lab = labels(sh, off, trees, depth)
                width, n = VALUE_BYTES * depth, len(rows) * trees
                cells = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(lab.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(take), b.column(1).take(take),
                    pa.array([g[k:k + 16] for k in range(0, len(g), 16)], pa.binary()), pa.array(np.diff(off)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, trees), pa.int32()), cells)],
                    names=["doc_id", "th", "g", "size", "labels"])

    return map_batches(docs, run, "doc_id long, th long, g binary, size long, labels array<binary>")


LINK, FIRST, LAST = range(3)


def _neighbours(depth: int):
    """Links of rows sorted by (tree, label, g) that share a prefix of ``depth`` values, and the partition's edges."""
    names = ["kind", "part", "tree", "label", "a", "b"]

    def edge(kind, part, row):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([row[0]], pa.int32()),
                                           pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary()), pa.nulls(1, pa.binary())], names=names)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            tree, g = b.column(0).to_numpy(), b.column(2)
            raw, off = text_buffers(b.column(1))
            label = raw[off[0]:off[-1]].reshape(len(tree), -1)
            now = (int(tree[0]), label[0].tobytes(), g[0].as_py())
            if last is None:
                yield edge(FIRST, part, now)
            elif last[0] == now[0] and last[1][:VALUE_BYTES * depth] == now[1][:VALUE_BYTES * depth]:
                yield pa.RecordBatch.from_arrays([pa.array([LINK], pa.int32()), pa.array([part], pa.int32()), pa.array([now[0]], pa.int32()),
                                                  pa.nulls(1, pa.binary()), pa.array([last[2]], pa.binary()), g.slice(0, 1)], names=names)
            shared = (tree[1:] == tree[:-1]) & (label[1:, :VALUE_BYTES * depth] == label[:-1, :VALUE_BYTES * depth]).all(1)
            at = np.flatnonzero(shared)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), LINK, np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array(tree[at], pa.int32()),
                pa.nulls(len(at), pa.binary()), g.take(pa.array(at)), g.take(pa.array(at + 1))], names=names)
            last = (int(tree[-1]), label[-1].tobytes(), g[len(tree) - 1].as_py())
        if last is not None:
            yield edge(LAST, part, last)

    return run


def candidate_links(reps: DataFrame, depth: int) -> DataFrame:
    """(a, b): neighbours in some sorted tree that share ``depth`` values; ``reps`` is (g, labels)."""
    nodes = reps.select(F.posexplode("labels").alias("tree", "label"), "g")
    found = materialize(map_batches(nodes.repartitionByRange("tree", "label", "g").sortWithinPartitions("tree", "label", "g"),
                                    _neighbours(depth), "kind int, part int, tree int, label binary, a binary, b binary"), "forest")
    prefix = F.substring("label", 1, VALUE_BYTES * depth)
    along = Window.orderBy("part", "kind")                      # two rows a partition: its first and its last
    edges = found.where(F.col("kind") != LINK).withColumn("prefix", prefix)
    edges = edges.select("kind", "a", ((F.lag("tree").over(along) == F.col("tree")) & (F.lag("prefix").over(along) == F.col("prefix"))).alias("shared"),
                         F.lag("a").over(along).alias("before"))
    over = edges.where((F.col("kind") == FIRST) & F.col("shared")).select(F.col("before").alias("a"), F.col("a").alias("b"))
    return found.where(F.col("kind") == LINK).select("a", "b").unionByName(over)


def _sets(docs: DataFrame) -> DataFrame:
    """Shingle set of each row as packed little-endian 64-bit values, other columns kept."""
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            for rows, sh, off in _shingle_sets(b.column(at)):
                take = pa.array(rows)
                packed = pa.Array.from_buffers(pa.binary(), len(rows), [
                    None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(sh)])
                yield pa.RecordBatch.from_arrays(
                    [packed if k == at else b.column(k).take(take) for k in range(b.num_columns)],
                    names=["sh" if n == "text" else n for n in b.schema.names])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name != "text" else "sh binary" for f in docs.schema)
    return map_batches(docs, run, kept)


def _similar(left: int, ids: np.ndarray, off: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Jaccard similarity of row ``left`` to every row (``ids``: shingles as small numbers)."""
    own = ids[off[left]:off[left + 1]]
    mark[own] = True
    both = np.add.reduceat(mark[ids], off[:-1], dtype=np.int64)
    mark[own] = False
    return both / (size[left] + size - both)


class _Block:
    """Sets of one task: digests, copies, packed sets; of two blocks, also the side and the linked group."""

    def __init__(self):
        self.key, self.side, self.g, self.copies, self.group, self.sets = None, [], [], [], [], []

    def links(self, threshold: float):
        """(linked copies of each row, pairs of row numbers that prove its groups linked).

        One block against itself, or (rows sorted by side) every row of side 0 against side 1.
        """
        side, copies = np.array(self.side), np.array(self.copies, np.int64)
        n, split = len(side), int((side == 0).sum())
        found, pairs = np.zeros(n, np.int64), []
        if n < 2 or side[0] == 1:
            return found, pairs
        size = np.array([len(x) for x in self.sets], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        ids = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        mark = np.zeros(ids.max() + 1, bool)
        far = 1 - _similar(0, ids, off, size, mark)   # distances to one row bound all others
        for i in range(min(split, n - 1)):
            later = np.arange(i + 1 if split == n else split, n)
            if not len(later):
                break
            if far[i] + far[later].max() <= 1 - threshold - 1e-9:
                linked = later
            else:
                linked = later[_similar(i, ids, off, size, mark)[later] >= threshold - 1e-12]
            if len(linked):
                found[i] += copies[linked].sum()
                found[linked] += copies[i]
                pairs += [(i, int(k)) for k in linked]
        return found, pairs


def _blocks(batches, done):
    """Stream over rows (key..., side, g, copies, group, sh) sorted by key: one key's block is held at a time."""
    block = _Block()
    for batch in batches:
        width = batch.num_columns - 5
        cols = [batch.column(k).to_pylist() for k in range(width + 4)]
        raw, off = text_buffers(batch.column(width + 4))
        for r in range(batch.num_rows):
            key = tuple(c[r] for c in cols[:width])
            if key != block.key:
                if block.g:
                    yield done(block)
                block = _Block()
                block.key = key
            if not block.g or block.g[-1] != cols[width + 1][r]:   # repeated rows bring a set more than once
                for field, c in zip((block.side, block.g, block.copies, block.group), cols[width:]):
                    field.append(c[r])
                block.sets.append(raw[off[r]:off[r + 1]].view(np.uint64).copy())
    if block.g:
        yield done(block)


def _inside(threshold: float):
    """(g, group, n) of the rows of each block: their linked group's smallest digest, and linked copies."""
    def done(block):
        found, pairs = block.links(threshold)
        root = _roots(len(block.g), pairs)
        least: dict = {}
        for k, r in enumerate(root):
            least[r] = min(least.get(r, block.g[k]), block.g[k])
        return pa.RecordBatch.from_arrays([pa.array(block.g, pa.binary()), pa.array([least[r] for r in root], pa.binary()), pa.array(found)],
                                          names=["g", "group", "n"])

    return lambda batches: _blocks(batches, done)


def _across(threshold: float):
    """(a, b, n) of two blocks: linked copies of each row (b null), links between the blocks' groups."""
    def done(block):
        found, pairs = block.links(threshold)
        a, b = _forest(*zip(*dict.fromkeys((block.group[i], block.group[k]) for i, k in pairs))) if pairs else ([], [])
        some = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array([block.g[k] for k in some] + a, pa.binary()), pa.array([None] * len(some) + b, pa.binary()),
                                           pa.array([*found[some].tolist(), *[0] * len(a)], pa.int64())], names=["a", "b", "n"])

    return lambda batches: _blocks(batches, done)


def _roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


def _forest(a: list, b: list) -> tuple[list, list]:
    """Links of a spanning forest of the given ones: at most one fewer than there are nodes."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep_a, keep_b = [], []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep_a.append(x)
            keep_b.append(y)
    return keep_a, keep_b


def jaccard_rows(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                 target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, k, th, class_id, n_links, first) of every row of ``docs`` (doc_id, text).

    (k, th) is the row's key: doc_id, nulls last, and a hash of the text. ``first`` marks the
    row that stands for its class, the one with the smallest key.
    """
    depth = forest_depth(threshold, trees, MAX_DEPTH, target)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                       F.col("text").cast("string").alias("text"))
    signed = materialize(_signed(rows.select("doc_id", "th", "text"), trees, MAX_DEPTH), "signed")
    order = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    reps = materialize(signed.groupBy("g").agg(
        F.min(F.struct(order.alias("k"), "th")).alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"), F.first("labels").alias("labels")), "reps")
    groups = connected_components(candidate_links(reps, depth))
    groups = materialize(groups.join(reps.select(F.col("g").alias("node"), "rep", "copies", "size"), "node"), "groups")
    counts, classes = _verified(rows, groups, threshold)
    per_set = (reps.select("g", "rep", "copies")
               .join(classes, "g", "left")
               .withColumn("root", F.coalesce("root", "g"))
               .join(counts, "g", "left"))
    lowest = per_set.groupBy("root").agg(F.min("rep").alias("low"))
    decided = per_set.join(lowest, "root").select("g", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    with_words = signed.select("doc_id", order.alias("k"), "th", "g").join(decided, "g").select(
        "doc_id", "k", "th", F.nullif("low.k", F.lit(NO_ID)).alias("class_id"), "n_links",
        ((F.col("k") == F.col("low.k")) & (F.col("th") == F.col("low.th"))).alias("first"))
    without = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return with_words.unionByName(without.select(
        "doc_id", order.alias("k"), "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                    target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text); see the module."""
    return jaccard_rows(docs, threshold, trees, target).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with the first row of each class; rows of one doc_id and text count as one."""
    keep = jaccard_rows(docs, threshold).where("first").select("k", "th").distinct()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("th"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    same = Window.partitionBy("k", "th").orderBy("k")
    return (rows.join(keep, ["k", "th"], "left_semi")
            .withColumn("n", F.row_number().over(same)).where("n = 1").select("kept.*"))


def _verified(rows: DataFrame, groups: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((g, n): linked copies of each set, (g, root): its class) over the candidate components."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"), (F.sum("size") * 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = (groups.join(sizes, "root").withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    active = dealt.select(F.col("rep.k").alias("k"), F.col("rep.th").alias("th"), F.col("node").alias("g"), "root", "copies", "blocks", "block")
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))

    def sets(of: DataFrame) -> DataFrame:
        return _sets(rows.withColumn("k", key).join(of, ["k", "th"]).drop("k", "th", "doc_id"))

    alone = sets(active).repartition("root", "block").sortWithinPartitions("root", "block", "g").select(
        "root", "block", F.lit(0).alias("side"), "g", "copies", F.lit(None).cast("binary").alias("group"), "sh")
    inside = materialize(map_batches(alone, _inside(threshold), "g binary, group binary, n long"), "inside")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")))
    pairs = (sets(active.where("blocks > 1").join(inside.select("g", "group"), "g")).withColumn("other", other)
             .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     F.when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "g", "copies", "group", "sh"))
    across = materialize(map_batches(pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "g"),
                                     _across(threshold), "a binary, b binary, n long"), "across")
    joined = connected_components(across.where("b is not null").select("a", "b"))
    counts = inside.select("g", "n").unionByName(across.where("b is null").select(F.col("a").alias("g"), "n"))
    classes = inside.select("g", "group").join(joined.withColumnRenamed("node", "group"), "group", "left").select(
        "g", F.coalesce("root", "group").alias("root"))
    return counts.groupBy("g").agg(F.sum("n").alias("n")), classes
