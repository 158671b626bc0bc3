"""The corpus pipeline stage by stage against plain Python on a small table."""
import re
from collections import Counter

import pytest

import corpus_pipeline
from linkflow.llm import bpe
from linkflow.session import materialize

ENGLISH = "the old man walked along the river and looked at the boats that were going home in the evening light number"
GERMAN = "der alte mann ging am ufer entlang und sah die boote die am abend nach hause fuhren mit dem licht nummer"
STORY = " ".join(f"word{i}" for i in range(60))
NEAR = STORY.replace("word30 ", "changed ")
SECRET = "please keep password = hunter2hunter2 away from the others in the house " + ENGLISH
ROWS = ([(i, f"{ENGLISH} {i} {i * 7} {i * i}", "en", "web") for i in range(1, 30)]
        + [(100 + i, f"{GERMAN} {i} {i * 5} {i * i}", "de", "books") for i in range(1, 30)]
        + [(200, STORY, "en", "web"), (201, STORY, "en", "web"), (202, NEAR, "en", None), (203, SECRET, "en", "web"),
           (204, None, "en", "web"), (205, "", None, "web"), (206, "123 456 !!!", "en", "books"), (None, ENGLISH + " no id", "en", "web")])
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def alike(a, b):
    if a == b:
        return True
    x, y = shingles(a), shingles(b)
    return bool(x and y) and len(x & y) / len(x | y) >= 0.8


def classes(texts):
    """Connected groups of rows whose texts are alike."""
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if alike(a, texts[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return [[i for i, g in enumerate(group) if g == name] for name in set(group)]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"), name)
        out[name] = docs
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_columns_stay_up_to_the_last_stage(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns
    assert stages[names[-1]].columns == ["doc_id", "n_tokens", "ids"]


def test_language_drops_only_unknown_texts(stages):
    kept = rows(stages["language_id"])
    assert not Counter(kept) - Counter(ROWS)
    ids = {r[0] for r in kept}
    assert not ids & {204, 205, 206}
    assert len(kept) >= len(ROWS) - 6     # clean rows stay


def test_one_row_of_each_class_stays(stages):
    before, after = rows(stages["language_id"]), rows(stages["jaccard_join"])
    groups = classes([r[1] for r in before])
    assert len(after) == len(groups) and not Counter(after) - Counter(before)
    left = {r[:2] for r in after}
    for group in groups:
        assert len({before[i][:2] for i in group} & left) == 1


def test_secrets_go_and_the_rest_of_the_text_stays(stages):
    before = {r[0]: r[1] for r in rows(stages["jaccard_join"])}
    after = {r.doc_id: r for r in stages["secret_scans"].collect()}
    assert set(before) == set(after) and 203 in after
    for i, text in before.items():
        found = ASSIGN.search(text)
        assert (after[i].text == text) == (found is None)
        assert after[i].n_chars == len(after[i].text)
    assert "hunter2hunter2" not in after[203].text and after[203].text.endswith(ENGLISH)


def test_mixing_repeats_whole_rows_the_same_way_each_time(spark, stages):
    before, mixed = rows(stages["secret_scans"]), rows(stages["source_mixing"])
    assert set(mixed) <= set(before) and mixed
    again = corpus_pipeline.mixing(spark, stages["secret_scans"].repartition(7), "unused")
    assert Counter(rows(again)) == Counter(mixed)


def test_tokens_decode_to_the_text(stages):
    coder = bpe.PieceCoder(bpe.tokenizer_path(), bpe.tokenizer_path(bpe.RANKS))
    encode = lambda t: tuple(coder.tokenizer.encode(t, add_special_tokens=False).ids)
    done = [(r.doc_id, tuple(r.ids)) for r in stages["bpe"].collect()]
    before = rows(stages["source_mixing"])
    assert Counter(done) == Counter((r[0], encode(r[1])) for r in before)
    texts = Counter((i, coder.tokenizer.decode(list(ids), skip_special_tokens=False)) for i, ids in done)
    assert texts == Counter(r[:2] for r in before)


def test_empty_input_gives_empty_output(spark, stages):
    docs = stages["input"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.collect() == []
