"""Joins of encoded chunks: agreement, growth where it fails, refusal of other vocabularies."""
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from linkflow.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.PieceCoder(bpe.tokenizer_path(), bpe.tokenizer_path(bpe.RANKS))


def texts():
    rnd = random.Random(3)
    bits = ["the cat", "don't", "é漢字", "  ", "\n\n", "123 abc", "a" * 50, "<|endoftext|>", "x_y", "...", "ﬁ", "tab\tend", "it's", "ALL CAPS", " x", "'s"]
    return [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(120)] + ["", None, "word " * 3000]


@pytest.mark.parametrize("bits", [0, 1, 3, 8])
def test_ids_of_all_cuts_are_those_of_the_library(coder, bits):
    column = pa.array(texts())
    found = [ids[a:b].tolist() for ids, first in bpe.token_slices(column, coder, bits) for a, b in zip(first, first[1:])]
    assert found == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]


def test_cuts_that_do_not_agree_are_joined(coder, monkeypatch):
    """Even with cuts at any space or letter, the pieces grow until the ids are right."""
    monkeypatch.setattr(bpe, "piece_bounds", lambda data, starts, bits: np.union1d(starts[starts < len(data)], np.flatnonzero((data < 128) & (data != 32))[::3]))
    column = pa.array(["hello world again", "the cat sat on the mat", "one two three"])
    dropped = []
    keep = bpe.agreed_bounds
    monkeypatch.setattr(bpe, "agreed_bounds", lambda *a: dropped.append((len(a[1]), len(keep(*a)))) or keep(*a))
    found = [ids[a:b].tolist() for ids, first in bpe.token_slices(column, coder) for a, b in zip(first, first[1:])]
    assert found == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
    assert all(after < before for before, after in dropped)


def test_slices_are_small(coder, monkeypatch):
    """A worker holds a megabyte of text at a time, however large the batch; the ids are the library's."""
    sizes = []
    bounds = bpe.piece_bounds
    monkeypatch.setattr(bpe, "piece_bounds", lambda data, starts, bits: sizes.append(len(data)) or bounds(data, starts, bits))
    words = [f"word{i} number {i * i} stands here" for i in range(2000)]
    column = pa.array([" ".join(words[i % 7::7]) for i in range(300)])
    found = [ids[a:b].tolist() for ids, first in bpe.token_slices(column, coder) for a, b in zip(first, first[1:])]
    assert sum(sizes) > 2 << 20 and max(sizes) <= 1 << 20
    assert found[:7] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in column.to_pylist()[:7]]
    assert found[7:] == found[:-7]


def test_agreement(coder):
    assert coder.agree(b" the", b" cat") and not coder.agree(b" th", b"e") and not coder.agree(b" do", b"n't")


@pytest.mark.parametrize("change", [
    lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d.update(pre_tokenizer=None), lambda d: d.update(pre_tokenizer={"type": "Whitespace"}),
    lambda d: d.update(normalizer={"type": "Lowercase"})])
def test_other_pre_tokenizers_are_refused(tmp_path, change):
    spec = json.load(open(bpe.tokenizer_path()))
    change(spec)
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.PieceCoder(str(tmp_path / "t.json"), bpe.tokenizer_path(bpe.RANKS))


def test_files_of_two_vocabularies_are_refused(tmp_path):
    lines = open(bpe.tokenizer_path(bpe.RANKS)).read().split("\n")
    a, b = lines[300].split(), lines[301].split()
    lines[300], lines[301] = f"{a[0]} {b[1]}", f"{b[0]} {a[1]}"
    (tmp_path / "r.tiktoken").write_text("\n".join(lines))
    with pytest.raises(ValueError, match="not that of the ranks"):
        bpe.PieceCoder(bpe.tokenizer_path(), str(tmp_path / "r.tiktoken"))
