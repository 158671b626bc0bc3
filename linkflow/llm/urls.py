"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob over the canonical URL, ``.`` + host + 0xFF + path: host rules become
``*.example.org<FF>/path*`` (the host and all its subdomains, then a path prefix), and the
method's own rules are free globs. All globs are packed into one run of bits over as many
64-bit words as they need: one bit per byte or ``?`` and one entry bit per glob; a ``*``
makes the bit before it keep itself alive. A step of the automaton shifts all states by one
bit, with carries between words, and masks them with the table row of the byte read, for
all rules and a whole batch of URLs at once.

Verdict: that of the longest host rule that fits; else ``block`` if any blocking glob fits;
else ``allow``. A null URL or one without ``://`` has an empty host and path, which no host
rule fits. Only A-Z are lower-cased in hosts. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block")]
BLOCK_GLOBS = ["*.ads-*", "*.ad.*", "*track*\xff*", "*.adult*\xff*", "*\xff*/cgi-bin/*", "*\xff*/login*", "*\xff*.exe"]
MARK = 0xFF                    # never a byte of UTF-8


def host_glob(rule: str) -> str:
    """The glob of a host rule ``host/path``."""
    host, _, path = rule.partition("/")
    return f"*.{host}\xff/{path}*"


class Automaton:
    """Packed state table of many globs; glob i accepts if its last bit is set at the end."""

    def __init__(self, globs: list[str]):
        tokens = []                                      # (glob, byte or None, entry bit)
        loops, self.accept = [], []
        for g in globs:
            entry = len(tokens)
            tokens.append((None, True))
            for ch in g:
                if ch == "*":
                    loops.append(len(tokens) - 1)
                elif ch == "?":
                    tokens.append((None, False))
                else:
                    tokens += [(c, False) for c in (b"\xff" if ch == "\xff" else ch.encode("utf-8"))]
            self.accept.append(len(tokens) - 1)
            assert entry < len(tokens)
        self.words = (len(tokens) + 63) // 64
        bit = lambda i: (i // 64, np.uint64(1 << (i % 64)))
        self.table = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for i, (c, entry) in enumerate(tokens):
            w, b = bit(i)
            if entry:
                self.start[w] |= b
            elif c is None:
                self.table[:, w] |= b
            else:
                self.table[c, w] |= b
        for i in loops:
            w, b = bit(i)
            self.loop[w] |= b

    def run(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """rows x globs booleans: which globs fit the whole of each row's bytes."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        live = size[order]
        state = np.repeat(self.start[None], len(size), 0)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(live[0]) if len(live) else 0):
            n = int(np.searchsorted(-live, -t, side="left"))   # rows longer than t
            s = state[:n]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.table[raw[off[order[:n]] + t]]) | (s & self.loop)
        out = np.zeros((len(size), len(self.accept)), bool)
        for g, i in enumerate(self.accept):
            out[order, g] = (state[:, i // 64] >> np.uint64(i % 64)) & one != 0
        return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: up to ``/``, ``?`` or ``#`` after the first ``://``; then up to ``?`` or ``#``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8").translate(_LOWER).decode("utf-8"), slash + path


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, globs: list[str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url)."""
    rules = sorted(HOST_RULES if rules is None else rules, key=lambda r: (-len(r[0]), r[0]))
    globs = BLOCK_GLOBS if globs is None else globs

    def run(batches):
        machine = Automaton([host_glob(r) for r, _ in rules] + list(globs))
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            urls = [b"." + h.encode("utf-8") + b"\xff" + p.encode("utf-8") for h, p in parts]
            off = np.concatenate([[0], np.cumsum([len(u) for u in urls], dtype=np.int64)]).astype(np.int64)
            fits = machine.run(np.frombuffer(b"".join(urls), np.uint8), off)
            by_rule = fits[:, :len(rules)]
            first = np.where(by_rule.any(1), by_rule.argmax(1), -1)   # rules are sorted, longest first
            blocked = fits[:, len(rules):].any(1)
            verdict = [rules[k][1] if k >= 0 else "block" if x else "allow" for k, x in zip(first.tolist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                pa.array([rules[k][0] if k >= 0 else None for k in first.tolist()], pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string")
