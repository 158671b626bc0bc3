"""Memory of the Python workers: bounded batches, freed memory given back at the end of every task."""
import numpy as np
import pyarrow as pa
import pytest

from linkflow.llm import bpe, language, neighbours, workers


def pss() -> int:
    """kB that this process holds by itself."""
    with open("/proc/self/smaps_rollup") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("Private_Dirty"))


@pytest.fixture
def default_limit(spark):
    spark.conf.unset(workers.BATCH_LIMIT)
    yield
    spark.conf.unset(workers.BATCH_LIMIT)


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])


def test_a_batch_is_bounded_by_its_bytes(spark, default_limit):
    docs = spark.range(9000, numPartitions=1).selectExpr("id", "repeat('some words ', 200) AS text")   # 20 MB, fewer rows than Spark puts in a batch
    found = workers.map_batches(docs, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 9000 and sum(r["bytes"] for r in found) > 16 << 20
    assert max(r["bytes"] for r in found) < workers.BATCH_BYTES * 1.25


def test_a_limit_of_the_session_stays(spark, default_limit):
    spark.conf.set(workers.BATCH_LIMIT, "1m")
    docs = spark.range(900, numPartitions=1).selectExpr("id", "repeat('some words ', 400) AS text")
    found = workers.map_batches(docs, sizes, "rows long, bytes long").collect()
    assert spark.conf.get(workers.BATCH_LIMIT) == "1m" and max(r["bytes"] for r in found) < 2 << 20


def test_freed_memory_goes_back():
    pieces = [bytes(1000) for _ in range(100_000)]              # small blocks under a last one that stays
    columns = [pa.array(np.zeros(1 << 18)) for _ in range(20)]
    held, pieces, columns = pss(), pieces[-1:], None
    workers.give_back()
    assert held - pss() > 80_000 and pieces and columns is None


def test_stages_run_in_bounded_batches_and_give_back(spark, default_limit, monkeypatch):
    """Language ID, join and tokens: all their Python tasks, and each only when its rows are out."""
    calls, given = [], []
    docs = spark.createDataFrame([(i, f"text number {i % 3} of the few rows that are here", "en") for i in range(6)],
                                 "doc_id long, text string, lang string").coalesce(1)
    frame = type(docs)
    real = frame.mapInArrow

    def recorded(self, run, schema, *more):
        calls.append((run, int(spark.conf.get(workers.BATCH_LIMIT).removesuffix("b"))))
        return real(self, run, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", recorded)
    langs, params = language.train([("en", b"some text"), ("de", b"ein Text")], rounds=1)
    language.label_documents(docs, (langs, params))
    language.known_language(docs, 0.0, (langs, params))
    bpe.encode_documents(docs)
    bpe.tokenized_documents(docs)
    neighbours.one_of_each_class(docs)
    assert len(calls) >= 9 and {limit for _, limit in calls} == {workers.BATCH_BYTES}
    monkeypatch.setattr(workers, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a text"]), pa.array(["en"])], names=["doc_id", "text", "lang"])
    rows = calls[1][0](iter([batch]))
    assert next(rows).num_rows == 1 and not given
    assert list(rows) == [] and given == [1]
