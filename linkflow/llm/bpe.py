"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last bytes hits a mask, so equal
passages give equal chunks wherever they stand. A chunk cut anywhere does not encode
exactly on its own: the pre-tokenizer may match across the cut. Joins are therefore
repaired: the stretch from the last safe boundary of the left chunk to the first safe
boundary of the right one is encoded again as one piece, growing over whole chunks until
it ends at safe boundaries on both sides. A safe boundary is a space between an ASCII
non-space byte and an ASCII letter: no alternative of the byte-level pre-tokenizer's
pattern matches across it and none looks past it. At every boundary used, the words on its
two sides are encoded together and apart; where the two encodings differ, the pieces are
joined and encoded again as one, until all joins agree (``agreed_bounds``). Every distinct
piece (chunk body or repaired join) is encoded once for all documents of a slice, every
distinct pair of words compared once, and bounded caches carry both on. Decoding looks up the
bytes of every id of a document. A vocabulary whose files disagree with each other, or whose
pre-tokenizer is not the byte-level one, is refused (``ValueError``).

Nulls count as empty text; an empty text has no tokens (the digests of the empty string).
Repeated rows give repeated results; the tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkflow.llm.words import SLICE_BYTES, slices, text_buffers
from linkflow.llm.workers import map_batches

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"   # the same vocabulary as ranks
CHUNK_BITS = 8                # a chunk ends at a byte with probability 2**-CHUNK_BITS
ROLL_BYTES = 16               # bytes under the rolling hash
SLICE_MB = 1                  # MB of text worked on at once (about 25 bytes of memory a byte)
CACHE_BYTES = 32 << 20        # pieces kept from slice to slice; the cache is emptied beyond
CACHE_JOINS = 100_000         # pairs of words at joins, likewise
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_bounds(data: np.ndarray, doc_starts: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Sorted boundaries of the pieces of a slice: document starts, and the first and last
    safe boundary of every rolling-hash chunk."""
    n = len(data)
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    safe = np.zeros(n, bool)
    if n > 2:
        safe[1:-1] = (data[1:-1] == 32) & (data[:-2] > 32) & (data[:-2] < 127) & letter[2:]
    inner = doc_starts[(doc_starts > 0) & (doc_starts < n)]
    safe[inner] = False
    safe[inner - 1] = False
    roll = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    for i in range(min(ROLL_BYTES, n)):
        roll[i:] += wide[:n - i] * np.uint32(pow(0x9E3779B1, i + 1, 1 << 32))
    roll ^= roll >> np.uint32(15)
    cut = (roll * np.uint32(0x85EBCA6B)).astype(np.uint64) >> np.uint64(32 - bits) == 0
    at = np.flatnonzero(safe)
    chunk = np.cumsum(cut, dtype=np.int64)[at]
    if len(at):
        edge = np.ones(len(at), bool)
        edge[1:-1] = (chunk[1:-1] != chunk[:-2]) | (chunk[1:-1] != chunk[2:])
        safe[at[~edge]] = False
    safe[doc_starts[doc_starts < n]] = True
    return np.flatnonzero(safe)


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceCoder:
    """Encodes pieces, each distinct one once while it is cached.

    Plain pieces go through the same vocabulary as ranks (the faster library of the two);
    pieces that hold a special token's string, control bytes or code points whose character
    class could differ between the libraries go through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        import base64
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one task, one thread
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.check(path, ranks)
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = max(self.tokenizer.get_vocab_size(), max(ranks.values()) + 1)
        spelled = [b""] * size
        for k, v in ranks.items():
            spelled[v] = k
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            spelled[i] = t.content.encode()
        self.spelled = pa.array(spelled, pa.large_binary())
        self.decimal = pa.array([f"{i}," for i in range(size)], pa.large_string())
        odd = np.zeros(256, bool)
        odd[:32] = odd[127] = odd[0xC2] = odd[0xE0:] = True
        odd[[9, 10, 13]] = False
        self.odd = odd
        self.reset()

    def check(self, path: str, ranks: dict[bytes, int]) -> None:
        """Safe boundaries hold for one pre-tokenizer, and the two files must be one vocabulary."""
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or {k: before.get(k) for k in BYTE_LEVEL} != BYTE_LEVEL:
            raise ValueError(f"{path}: not a byte-level pre-tokenizer without prefix space")
        letters, added = byte_letters(), set(self.tokenizer.get_added_tokens_decoder())
        spelled = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in added}
        if spelled != ranks:
            raise ValueError(f"{path}: its vocabulary is not that of the ranks")

    def reset(self):
        self.seen: dict[bytes, np.ndarray] = {}
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.held = 0

    def agree(self, left: bytes, right: bytes) -> bool:
        """Two words beside each other encode together as they do apart."""
        known = self.joins.get((left, right))
        if known is None:
            if len(self.joins) >= CACHE_JOINS:
                self.joins.clear()
            ids = [self.encode(w, not w.isascii()) for w in (left, right, left + right)]
            known = self.joins[left, right] = ids[0].tolist() + ids[1].tolist() == ids[2].tolist()
        return known

    def encode(self, piece: bytes, odd: bool) -> np.ndarray:
        text = piece.decode("utf-8")
        if odd:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def lookup(self, pieces: list[bytes], odd: list[bool], marked: bool) -> list[np.ndarray]:
        """Token ids of every piece, after encoding those that are new.

        marked: some piece may hold a special token's string.
        """
        if marked:
            odd = [o or any(s in p for s in self.special) for p, o in zip(pieces, odd)]
        if self.held > CACHE_BYTES:
            self.reset()
        seen, out = self.seen, []
        for p, o in zip(pieces, odd):
            ids = seen.get(p)
            if ids is None:
                ids = seen[p] = self.encode(p, o)
                self.held += len(p) + 4 * len(ids) + 200
            out.append(ids)
        return out


def _digests(parts: pa.Array, bounds: np.ndarray, drop: int) -> list[str]:
    """sha256 of the joined parts bounds[i]:bounds[i+1]; ``drop`` trailing bytes are left out."""
    raw, off = text_buffers(parts)
    view = memoryview(raw)
    return [hashlib.sha256(view[a:max(a, b - drop)]).hexdigest()
            for a, b in zip(off[bounds[:-1]].tolist(), off[bounds[1:]].tolist())]


def agreed_bounds(data: bytes, bounds: np.ndarray, starts: np.ndarray, agree) -> np.ndarray:
    """``bounds`` without those at which the words on the two sides do not encode apart as together.

    Leaving a boundary out joins the pieces on its sides, which are then encoded as one.
    """
    first = np.isin(bounds, starts)
    keep = np.ones(len(bounds), bool)
    at = bounds.tolist()
    for k in np.flatnonzero(~first).tolist():
        low, b, high = at[k - 1], at[k], at[k + 1] if k + 1 < len(at) else len(data)
        left, right = max(low, data.rfind(b" ", low, b)), data.find(b" ", b + 1, high)
        keep[k] = agree(data[left:b], data[b:right if right > 0 else high])
    return bounds[keep]


def token_slices(texts: pa.Array, coder: PieceCoder, bits: int = CHUNK_BITS):
    """For each slice of a column: (token ids of its documents in a row, bounds of each document)."""
    raw, off = text_buffers(texts)
    for i, j in slices(off, SLICE_MB * SLICE_BYTES):
        lo, hi = int(off[i]), int(off[j])
        starts = off[i:j] - lo
        data = np.ascontiguousarray(raw[lo:hi])
        whole = data.tobytes()
        bounds = agreed_bounds(whole, piece_bounds(data, starts, bits), starts, coder.agree)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds), [
            None, pa.py_buffer(np.append(bounds, hi - lo).astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        odd = np.zeros(len(coded.dictionary), bool)
        if len(bounds):
            odd[which] = np.logical_or.reduceat(coder.odd[data], bounds)
        tokens = coder.lookup(coded.dictionary.to_pylist(), odd.tolist(),
                              any(s in whole for s in coder.special))
        flat = np.concatenate([np.zeros(0, np.uint32), *tokens])
        size = np.array([len(t) for t in tokens], np.int64)
        begin = np.cumsum(size) - size
        total = np.concatenate([[0], np.cumsum(size[which])]).astype(np.int64)
        ids = flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], size[which])]
        yield ids, total[np.searchsorted(bounds, np.append(starts, hi - lo), side="left")]


def encode_column(texts: pa.Array, coder: PieceCoder, bits: int = CHUNK_BITS):
    """(token counts, digests of the ids, digests of the decoded texts) of a column of texts."""
    counts, ids_sha, text_sha = [np.zeros(0, np.int64)], [], []
    for ids, first in token_slices(texts, coder, bits):
        ids = pa.array(ids)
        counts.append(np.diff(first))
        ids_sha += _digests(coder.decimal.take(ids), first, 1)
        text_sha += [hashlib.sha256(x).hexdigest() for x in _decoded(coder.spelled.take(ids), first)]
    return np.concatenate(counts), ids_sha, text_sha


def _decoded(spelled: pa.Array, bounds: np.ndarray):
    """UTF-8 bytes of each document's decoded text; broken sequences become U+FFFD, as in the library."""
    raw, off = text_buffers(spelled)
    view = memoryview(raw)
    for a, b in zip(off[bounds[:-1]].tolist(), off[bounds[1:]].tolist()):
        yield str(view[a:b], "utf-8", "replace").encode("utf-8")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, bits: int = CHUNK_BITS) -> DataFrame:
    """Per document: token count, sha256 of its ids, sha256 of the text decoded from them.

    ``tokenizer`` and ``ranks`` name one byte-level BPE vocabulary among the public files, in
    the two libraries' formats; they are opened where the task runs. One pass over the rows, no shuffle.
    """
    def run(batches):
        coder = PieceCoder(tokenizer_path(tokenizer), tokenizer_path(ranks))
        for b in batches:
            n_tok, ids_sha, text_sha = encode_column(b.column(1), coder, bits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_tok, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, SCHEMA)


def tokenized_documents(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str = RANKS, bits: int = CHUNK_BITS) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: the token ids themselves."""
    def run(batches):
        coder = PieceCoder(tokenizer_path(tokenizer), tokenizer_path(ranks))
        for b in batches:
            row = 0
            for ids, first in token_slices(b.column(1), coder, bits):
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(row, n), pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "n_tokens", "ids"])
                row += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids array<int>")
