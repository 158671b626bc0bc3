"""Secret scans by multipart credential linking, in DataFrame operations alone.

Every text is matched against one expression per kind. Three kinds are reported on their
own: ``assign`` (a keyword given a value), ``access`` (access key identifiers) and ``hex``
(long hex digests or keys). Three weak kinds are candidates only: ``ident`` (a user, client
or key name given a value), ``opaque`` (a long mixed run of letters and digits) and
``endpoint`` (an address). All spans of a document are interval-joined: two spans lie in
one scope if at most ``SCOPE`` code points are between them, and a weak candidate is
reported only when the parts that complete it are in its scope -- an ``opaque`` value with
an identifier, an ``ident`` with a secret, an ``endpoint`` with both -- and it does not
overlap a span of the first three kinds.

The join is a sweep over the spans sorted by start: the nearest part of each role before
and after a span decides, so n spans of a document cost n rows, never n * n. Matches
become rows; their positions are running sums of the lengths of the text between matches.
Only lengths and positions are shuffled, unless the text is to be redacted.

Positions count code points, ends are exclusive. A null text counts as empty and has no
spans. Rows are told apart by their place in the scan, so repeated rows each give their
result. Columns other than the ones named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOPE = 200                    # code points between two spans of one scope
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_IDENT, MIN_OPAQUE = 8, 16, 32, 4, 20


def either_case(word: str) -> str:
    """An expression for ``word`` with ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
# (kind, expression, group that is measured, least length); the order breaks ties of start
KINDS = [
    ("assign", "(" + either_case("password|passwd|secret|token|api_?key") + ")" + _GIVEN + "([A-Za-z0-9+/_.=-]+)", 2, MIN_VALUE),
    ("access", "AKIA[A-Z0-9]+", 0, MIN_ACCESS),
    ("hex", "[0-9a-f]{%d,}" % MIN_HEX, 0, MIN_HEX),
    ("ident", "(" + either_case("username|user|login|client_?id|key_?id|account") + ")" + _GIVEN + "([A-Za-z0-9_.@-]+)", 2, MIN_IDENT),
    ("opaque", "[A-Za-z0-9+/]{%d,}" % MIN_OPAQUE, 0, MIN_OPAQUE),
    ("endpoint", r"""(https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 0),
]
BASE = ("assign", "access", "hex")
IDENTIFIER = ("access", "ident")
SECRET = ("assign", "hex", "opaque")
# starting only where a run starts gives the same matches with less work
_FASTER = {"opaque": "(?<![A-Za-z0-9+/])", "hex": "(?<![0-9a-f])"}


def _matches(text: Column, rank: int) -> Column:
    """Array of (rank, i, before, len, ok): each match's length and that of the text before it."""
    kind, expr, group, least = KINDS[rank]
    expr = F.lit(_FASTER.get(kind, "") + expr)
    between = F.split(text, _FASTER.get(kind, "") + KINDS[rank][1], -1)
    whole = F.regexp_extract_all(text, expr, F.lit(0))
    measured = F.regexp_extract_all(text, expr, F.lit(group)) if group else whole
    ok = lambda w, m: F.length(m) >= least
    if kind == "opaque":
        ok = lambda w, m: w.rlike("[0-9]") & w.rlike("[A-Z]") & w.rlike("[a-z]")
    rows = F.transform(F.arrays_zip(between.alias("t"), whole.alias("w"), measured.alias("m")), lambda x, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("i"), F.length(x["t"]).alias("before"),
        F.length(x["w"]).alias("len"), ok(x["w"], x["m"]).alias("ok")))
    rows = F.filter(rows, lambda x: x["len"].isNotNull())
    # most texts have no match of a kind: one search then does
    return F.when(text.rlike(_FASTER.get(kind, "") + KINDS[rank][1]), rows)


def _nearest(roles, order, value: Column, pick) -> Column:
    return pick(F.when(F.col("kind").isin(*roles), value)).over(order)


def linked_spans(docs: DataFrame, keep: list[str], carry_text: bool = False) -> DataFrame:
    """One row per input row: ``row``, struct ``kept`` (columns ``keep``), ``found`` and, if asked, ``body``.

    ``found`` is a sorted array of (start, rank, kind, end, base) of all reported spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in keep]).alias("kept"),
                       text.alias("body"))
    empty = F.expr("cast(array() as array<struct<rank:int,i:int,before:int,len:int,ok:boolean>>)")
    found = F.concat(*[F.coalesce(_matches(F.col("body"), k), empty) for k in range(len(KINDS))])
    parts = rows.select("row", F.posexplode_outer(found).alias("p", "m"), "kept", "body")
    first = F.coalesce(F.col("p") == 0, F.lit(True))
    parts = parts.select("row", F.when(first, F.col("kept")).alias("kept"),
                         *([F.when(first, F.col("body")).alias("body")] if carry_text else []), "m.*")
    parts = parts.repartition("row")
    in_kind = Window.partitionBy("row", "rank").orderBy("i")
    spans = (parts
             .withColumn("end", F.sum(F.col("before") + F.col("len")).over(in_kind.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
             .withColumn("start", F.col("end") - F.col("len"))
             .withColumn("kind", F.when(F.col("ok"), F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("rank") + 1)))
             .withColumn("base", F.col("kind").isin(*BASE)))
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    for name, roles in (("id", IDENTIFIER), ("sec", SECRET), ("base", BASE)):
        spans = spans.withColumn(f"{name}_end", _nearest(roles, before, F.col("end"), F.max))
    for name, roles in (("id", IDENTIFIER), ("sec", SECRET), ("base", BASE)):
        spans = spans.withColumn(f"{name}_start", _nearest(roles, after, F.col("start"), F.min))
    in_scope = {n: F.coalesce(F.col("start") - F.col(f"{n}_end") <= SCOPE, F.lit(False))
                | F.coalesce(F.col(f"{n}_start") - F.col("end") <= SCOPE, F.lit(False)) for n in ("id", "sec")}
    overlaps = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    complete = (F.when(F.col("kind") == "opaque", in_scope["id"])
                .when(F.col("kind") == "ident", in_scope["sec"])
                .when(F.col("kind") == "endpoint", in_scope["id"] & in_scope["sec"]))
    reported = F.col("base") | (complete & ~overlaps)
    one = F.when(reported, F.struct("start", "rank", "kind", "end", "base"))
    return spans.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"),
        *([F.first("body", ignorenulls=True).alias("body")] if carry_text else []),
        F.array_sort(F.collect_list(one)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans as text."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["base"])
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return linked_spans(docs, ["doc_id"]).select(
        F.col("kept.doc_id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(found).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; texts without spans are unchanged.

    Overlapping spans are replaced as one. All columns are kept; a null text stays null.
    """
    cols = docs.columns
    src = docs if text == "text" else docs.withColumn("text", F.col(text))
    r = linked_spans(src, cols, carry_text=True)
    # running maximum of ends cuts overlaps: (from, to) is the text kept before each span
    reach = F.transform(F.col("found"), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.coalesce(F.array_max(F.transform(F.slice(F.col("found"), 1, i), lambda x: x["end"])), F.lit(0)).alias("reach")))
    kept = F.transform(reach, lambda s: F.concat(
        F.substring(F.col("body"), s["reach"] + 1, F.greatest(F.lit(0), s["start"] - s["reach"])),
        F.when((s["start"] >= s["reach"]), F.lit(mark)).otherwise(F.lit(""))))
    last = F.array_max(F.transform(F.col("found"), lambda s: s["end"]))
    new = F.when(F.size("found") == 0, F.col(f"kept.{text}")).otherwise(
        F.concat(F.array_join(kept, ""), F.substring(F.col("body"), last + 1, F.length("body"))))
    return r.select(*[new.alias(c) if c == text else F.col("kept")[c].alias(c) for c in cols])
