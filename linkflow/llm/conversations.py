"""Conversation structure repair: cheapest edits of turns, by a grammar-compressed dynamic programme.

A conversation's rows (conv_id, turn, role, text) are taken by turn. A row's first fault counts:
blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier in the conversation),
truncated (the last such character is not one of ``.!?``). Rows are kept (free), given the role
user or assistant (1) or deleted (2; blank and duplicate rows must be), and empty turns inserted
(5); a truncated row that stays costs 5 more. ``summaries`` finds the cheapest edits after which
the roles' initials read ``(s?(ua)+)?``, ties by the ASCII-least audit; ``repaired_turns``
carries them out.

On Spark: rows without their texts are range-partitioned by conversation and turn, so that a
conversation of any length is dealt over tasks, and cut into segments of at most ``SEGMENT``
rows. Equal segments are one row from then on. Each shard of distinct segments is compressed by
Re-Pair and solved with one matrix per rule (``grammar.py``); the segments' matrices are then
multiplied along each conversation. Texts are shuffled once, to be written out in order.

Hot groups: a conversation's rows meet in one task only as segments, a thousandth of them, and
where its texts are streamed in order; nothing there is held but its audit (a letter a row,
which the result holds too). Copies of one segment are one row; a row repeated in one
conversation is found by a grouped minimum, combined before the shuffle.

Defined cases: a null conv_id is a conversation of its own; a null role, text or (in the damage
key) id counts as one space; null turns come first and are left out of gaps; rows of one turn
are ordered by role and by the sha256 of the text, and repeated rows are duplicates; an empty
table has no conversations; other columns are ignored. Roles are known by their first
character; any but s, u, a are changed or deleted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm import grammar as g
from linkflow.llm.order import laid_out
from linkflow.session import materialize

SPACE = " \t\n\x0b\x0c\r"
SEGMENT_BITS = 10              # a segment is a piece of 1,024 places
SHARD = 1 << 16                # symbols that share one grammar


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the test damage, by crc32(``conv_id:turn``) % 20: drop, empty, unmark, repeat, set user."""
    def text_of(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
        (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("hit"))
    hit = F.col("hit")
    times = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("hit <> 0").select(
        "conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("copy")).drop("copy")


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest of the text: what every step orders rows by."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
                        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


ORDER = ["conv_id", "turn", "role", "digest"]


def _solve(batches):
    """(seq, illegal, costs, audits) of distinct segments, a shard of them at a time."""
    def done(held):
        costs, audits, illegal = [], [], []
        for seq, matrix in zip(held, g.matrices([np.frombuffer(s.encode(), np.uint8) - 97 for s in held])):
            cells = [matrix.get((i, j)) for i in range(4) for j in range(4)]
            costs.append([None if c is None else c[0] for c in cells])
            audits.append([None if c is None else str(c[1]) for c in cells])
            roles = "".join(g.ROLES[(ord(c) - 97) // 3] for c in seq)
            illegal.append(sum(roles[k:k + 2] not in g.LEGAL for k in range(len(roles) - 1)))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(illegal, pa.int64()),
                                           pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
                                          names=["seq", "illegal", "costs", "audits"])

    held, size = [], 0
    for batch in batches:
        for seq in batch.column(0).to_pylist():
            held.append(seq)
            size += len(seq)
            if size >= SHARD:
                yield done(held)
                held, size = [], 0
    if held:
        yield done(held)


class _Chain:
    """Product of a stream of matrices, equal lengths multiplied first: ropes stay shallow."""

    def __init__(self):
        self.parts: list[tuple[int, g.Matrix]] = []

    def add(self, matrix: g.Matrix) -> None:
        size = 1
        while self.parts and self.parts[-1][0] == size:
            matrix, size = g.product(self.parts.pop()[1], matrix), 2 * size
        self.parts.append((size, matrix))

    def total(self) -> g.Matrix:
        matrix = self.parts[-1][1]
        for _, earlier in reversed(self.parts[:-1]):
            matrix = g.product(earlier, matrix)
        return matrix


def _along(batches):
    """(conv_id, illegal, cost, audit) from the segments of each conversation, sorted by place."""
    def row(conv, illegal, chain):
        return (conv, illegal, *g.best(chain.total()))

    conv, chain, illegal, last = None, None, 0, ""
    for batch in batches:
        out = []
        for now, seq, inside, costs, audits in zip(*(c.to_pylist() for c in batch.columns)):
            if chain is None or now != conv:
                if chain is not None:
                    out.append(row(conv, illegal, chain))
                conv, chain, illegal, last = now, _Chain(), 0, ""
            chain.add({(k // 4, k % 4): (c, g.Rope(a)) for k, (c, a) in enumerate(zip(costs, audits)) if c is not None})
            roles = [g.ROLES[(ord(seq[k]) - 97) // 3] for k in (0, -1)]
            illegal += inside + (last != "" and last + roles[0] not in g.LEGAL)
            last = roles[1]
        yield _table(out)
    if chain is not None:
        yield _table([row(conv, illegal, chain)])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


def summaries(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``ids`` (conv_id) names more conversations, which may have no rows in ``turns``.
    """
    spoken = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    light = _rows(turns).select(
        *ORDER, (F.length(spoken) == 0).alias("blank"), F.right(spoken, F.lit(1)).isin(".", "!", "?").alias("ended"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role_class"))
    laid = laid_out(light, ORDER, "place", "turns")
    firsts = laid.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    marked = laid.join(firsts, "place", "left").select("conv_id", "turn", "place", "role_class", fault.alias("fault"))
    code = 3 * F.col("role_class") + F.when(F.col("fault") == "truncated", g.CUT).when(F.col("fault").isNotNull(), g.GONE).otherwise(g.FINE)
    marked = materialize(marked.withColumn("letter", F.char(97 + code)), "turns-marked")

    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, F.lit(1))).alias(f) for f in ("blank", "duplicate", "truncated")])
    in_order = F.sort_array(F.collect_list(F.struct("place", "letter")))           # at most 1,024
    segments = materialize(marked.groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment")).agg(
        F.array_join(F.transform(in_order, lambda c: c["letter"]), "").alias("seq")), "segments")
    solved = materialize(segments.select("seq").distinct().repartitionByRange("seq").sortWithinPartitions("seq")
                         .mapInArrow(_solve, "seq string, illegal long, costs array<long>, audits array<string>"), "solved")
    chained = (segments.join(solved, "seq").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
               .select("conv_id", "seq", "illegal", "costs", "audits")
               .mapInArrow(_along, "conv_id long, illegal long, cost long, audit string"))
    every = marked.select("conv_id") if ids is None else marked.select("conv_id").unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")))
    every = every.distinct()
    for side in (counts, chained):
        renamed = side.withColumnRenamed("conv_id", "own")
        every = every.join(renamed, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"))


NAMES = {g.AFTER_U: "user", g.AFTER_A: "assistant"}


def _edit(batches):
    """Turns after the edits, from rows sorted by conversation with its audit in front."""
    names = ["conv_id", "place", "role", "text", "edit"]
    conv, audit, at, state, place = None, "", 0, g.START, 0

    def inserted(out):
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = g.AFTER_A if state == g.AFTER_U else g.AFTER_U
            out.append((conv, place, NAMES[state], "", "I"))
            at, place = at + 1, place + 1

    def batch_of(out):
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=names)

    for batch in batches:
        out = []
        for now, line, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if line is not None:
                inserted(out)
                conv, audit, at, state, place = now, line, 0, g.START, 0
                continue
            inserted(out)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = g.AFTER_A if state == g.AFTER_U else g.AFTER_U
                role = NAMES[state]
            else:
                state = g.STEPS[state, role[0]]
            out.append((conv, place, role, text, edit))
            place += 1
        yield batch_of(out)
    out = []
    inserted(out)
    yield batch_of(out)


def repaired_turns(turns: DataFrame, summary: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of every turn that the edits leave or insert.

    A conversation's turns stand behind each other, in order, in one partition.
    """
    rows = _rows(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.lit(None).cast("string").alias("audit"), "text")
    lines = summary.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("binary").alias("digest"), "audit", F.lit(None).cast("string").alias("text"))
    both = rows.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    return both.select("conv_id", "audit", "role", "text").mapInArrow(
        _edit, "conv_id long, place long, role string, text string, edit string")


def _digests(batches):
    conv, sha = None, None
    names = ["own", "repaired_sha256"]
    for batch in batches:
        out = []
        for now, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if place == 0:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = now, hashlib.sha256()
            sha.update((("\n" if place else "") + role + ":" + text).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=names)
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], names=names)


def repair_report(conversations: DataFrame) -> DataFrame:
    """``summaries`` of the damaged rows, with the sha256 of the repaired ``role:text`` lines."""
    turns = damaged(conversations)
    summary = materialize(summaries(turns, conversations.select("conv_id")), "repairs")
    digests = repaired_turns(turns, summary).mapInArrow(_digests, "own long, repaired_sha256 string")   # narrow: order kept
    joined = summary.join(digests, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
