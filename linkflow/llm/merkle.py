"""Merkle manifest of a document table, proved by Octopus multiproofs.

Every row is a leaf: the sha256 (lowercase hex) of doc_id, source, lang, n_chars and text, each
as ``-`` if null and else as its UTF-8 byte count, ``:`` and its value. The leaves of a source,
in ascending order of doc_id, make a tree: while several nodes remain, every ``FANOUT``
consecutive ones (the last run may be shorter, even one) become the sha256 of their digests'
hex text. What remains is the source's subroot; the subroots, ordered by source, make one more
tree, whose top is the root.

* ``build_manifest`` numbers the leaves by a range partitioning (never a window over a source),
  and builds the trees level by level with grouped aggregations of at most ``FANOUT`` rows.
* ``prove`` deals leaves in partitions of about ``BLOCK``, aligned to the tree: a piece of a
  large source, or whole small sources that follow each other. A partition works out the
  smallest set of nodes it lacks (``missing_nodes``): a node derived from its own leaves, or
  needed by several of them, is not asked for, or once. The nodes are fetched by one join,
  interior nodes above the leaves are derived once, and each leaf's own proof is read off them.

Hot groups: a source with a third of all rows is dealt over tasks by position in every step.
Nodes near the root are asked for by every partition, one row each (a 4096th of the leaves).

Defined cases: null columns count as ``-``; a null source is a source of its own and comes
first, a null doc_id comes first in its source; rows of one doc_id are ordered by digest, so
repeated rows are leaves beside each other; an empty text is ``0:``; an empty table has no
leaves and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkflow.llm.order import numbered
from linkflow.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
BLOCK = 4096                   # leaves of one proving partition; a power of FANOUT
TOP = -1                       # number of the tree over the sources' subroots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """``leaves`` (doc_id, tree, at, n, leaf, other, sources, part_a, part_b), ``nodes`` (tree, level, at, digest)."""

    leaves: DataFrame
    nodes: DataFrame


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """A row's leaf as 32 bytes, with some fields' values replaced by ``changed``."""
    def one(name: str) -> Column:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[one(name) for name in FIELDS]).cast("binary"), 256))


def _levels(bottom: DataFrame, most: int) -> list[DataFrame]:
    """``bottom`` (tree, at, n, digest) and every level above it; a tree ends at its single node."""
    levels = [bottom]
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("at", "digest")))               # at most FANOUT
        text = F.concat_ws("", F.transform(run, lambda c: F.lower(F.hex(c["digest"]))))
        above = levels[-1].where("n > 1").groupBy(
            "tree", F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
        levels.append(materialize(above, "merkle-level"))
        most = -(-most // FANOUT)
    return levels


def build_manifest(docs: DataFrame, other: Column | None = None) -> Manifest:
    """Leaves and nodes of ``docs`` (``FIELDS``); ``other`` is a second digest kept beside each leaf."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       leaf_digest().alias("leaf"), (leaf_digest() if other is None else other).alias("other"))
    placed = numbered(materialize(rows, "merkle-rows"), ["source", "doc_id", "leaf"], "place", "part", "merkle-leaves")
    runs = materialize(placed.groupBy("source", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-runs")
    sources = numbered(runs.groupBy("source").agg(F.min("first").alias("start"), F.sum("rows").alias("n")),
                       ["source"], "tree", "source_part", "merkle-sources").withColumnRenamed("source", "name")
    found = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    count, most = found[0], found[1] or 0
    known = runs.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "name", F.col("part").alias("in_part"), "tree", "start", "n")
    large = F.col("n") > BLOCK
    at = F.col("place") - F.col("start")
    leaves = placed.join(known, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "tree", at.alias("at"), "n", "leaf", "other", F.lit(count).cast("long").alias("sources"),
        F.when(large, F.col("tree")).otherwise(TOP).alias("part_a"),
        F.floor(F.when(large, at).otherwise(F.col("start")) / BLOCK).alias("part_b"))
    leaves = materialize(leaves, "merkle-numbered")
    levels = _levels(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")), most)
    subroots = None
    for level in levels:
        top = level.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"),
                                          F.lit(count).cast("long").alias("n"), "digest")
        subroots = top if subroots is None else subroots.unionByName(top)
    nodes = None
    for side in (levels, _levels(materialize(subroots, "merkle-subroots"), count)):
        for depth, level in enumerate(side):
            part = level.select("tree", F.lit(depth).alias("level"), "at", "digest")
            nodes = part if nodes is None else nodes.unionByName(part)
    return Manifest(leaves, nodes)


def missing_nodes(known: set[int], n: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes needed beside ``known`` leaves of a tree of ``n`` to reach its top."""
    asked, level = [], 0
    while n > 1:
        above = {i // FANOUT for i in known}
        asked += [(level, i) for g in above for i in range(g * FANOUT, min((g + 1) * FANOUT, n)) if i not in known]
        known, n, level = above, -(-n // FANOUT), level + 1
    return asked


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """(runs by level: {index of the node above: its children's digests, joined}, the top's digest)."""
    runs, level = [], 0
    while n > 1:
        groups = {g: "".join(known[i] if i in known else fetched[level, i] for i in range(g * FANOUT, min((g + 1) * FANOUT, n)))
                  for g in {i // FANOUT for i in known}}
        runs.append(groups)
        known, n, level = {g: sha(s) for g, s in groups.items()}, -(-n // FANOUT), level + 1
    return runs, known[0]


def siblings(at: int, runs: list[dict[int, str]]) -> list[tuple[str, str]]:
    """(digests left, digests right) of a node's run at every level; 64 hex digits a digest."""
    out = []
    for groups in runs:
        above, k = divmod(at, FANOUT)
        out.append((groups[above][:64 * k], groups[above][64 * (k + 1):]))
        at = above
    return out


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way up give."""
    for left, right in proof:
        leaf = sha(left + leaf + right)
    return leaf


def _requests(block: pd.DataFrame) -> pd.DataFrame:
    """Coordinates that a partition of leaves lacks, of its sources' trees and of the top tree."""
    a, b = int(block["part_a"].iloc[0]), int(block["part_b"].iloc[0])
    asked = []
    for tree, own in block.groupby("tree"):
        asked += [(int(tree), *c) for c in missing_nodes(set(own["at"].tolist()), int(own["n"].iloc[0]))]
    asked += [(TOP, *c) for c in missing_nodes(set(block["tree"].tolist()), int(block["sources"].iloc[0]))]
    return pd.DataFrame([(a, b, *c) for c in asked], columns=["part_a", "part_b", "tree", "level", "at"])


PROOF = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string"


def _proofs(leaves: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Each leaf's proof, and the root that its other digest gives with the same siblings."""
    have: dict[int, dict] = {}
    for tree, level, at, digest in zip(fetched["tree"], fetched["level"], fetched["at"], fetched["digest"]):
        have.setdefault(int(tree), {})[int(level), int(at)] = bytes(digest).hex()
    if not len(leaves):
        return pd.DataFrame(columns=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"])
    trees = {}
    for tree, own in leaves.groupby("tree"):
        trees[tree] = climb({int(i): bytes(d).hex() for i, d in zip(own["at"], own["leaf"])}, int(own["n"].iloc[0]), have.get(int(tree), {}))
    top, root = climb({int(t): s for t, (_, s) in trees.items()}, int(leaves["sources"].iloc[0]), have.get(TOP, {}))
    over = {t: siblings(int(t), top) for t in trees}
    out = []
    for doc, tree, at, leaf, other in zip(leaves["doc_id"], leaves["tree"], leaves["at"], leaves["leaf"], leaves["other"]):
        runs, subroot = trees[tree]
        proof = siblings(int(at), runs) + over[tree]
        out.append((None if pd.isna(doc) else int(doc), bytes(leaf).hex(), subroot, root, "".join(x + y for x, y in proof), fold(bytes(other).hex(), proof)))
    done = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"])
    done["doc_id"] = done["doc_id"].astype("Int64")
    return done


def prove(manifest: Manifest, chosen: DataFrame | None = None) -> DataFrame:
    """``PROOF`` of the chosen rows of ``manifest.leaves`` (all if none are named).

    proof: the siblings' digests, left to right, level by level from the leaf to the root;
    folded_root: the root that the leaf's ``other`` digest gives with them.
    """
    leaves = manifest.leaves if chosen is None else chosen
    asked = leaves.select("part_a", "part_b", "tree", "at", "n", "sources").groupBy("part_a", "part_b").applyInPandas(
        _requests, "part_a long, part_b long, tree long, level int, at long")
    fetched = asked.join(manifest.nodes, ["tree", "level", "at"])
    return leaves.groupBy("part_a", "part_b").cogroup(fetched.groupBy("part_a", "part_b")).applyInPandas(_proofs, PROOF)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the decimal doc_id."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; see ``tampered``."""
    manifest = build_manifest(docs, leaf_digest({"text": tampered(F.col("doc_id"), F.col("text"))}))
    return prove(manifest).select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                                  "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
