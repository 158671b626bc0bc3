"""Cheapest repairs of role and fault sequences: Re-Pair grammar, min-plus transfer matrices, audit ropes.

A conversation's rows are symbols: role class (s, u, a, other) times fault (none, must go,
truncated). A symbol's transfer matrix holds, for every pair of states of the automaton of
``(s?(ua)+)?``, the cheapest edits that read the symbol between them: cost and audit, the
edits' initials. Matrices are multiplied in the min-plus way, ties broken by the smaller
audit; that is a semiring, because two audits of equal cost for the same rows are never a
prefix of each other (the longer one would have more inserts, hence a higher cost).

``compress`` replaces frequent neighbours by rules (Re-Pair) in many sequences at once;
``matrices`` makes one matrix per rule, bottom-up, so that sequences share them. Audits are
ropes: a rule's audit refers to its parts' audits, and two ropes are compared by the codes of
their prefixes, without writing them out.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np

START, AFTER_S, AFTER_U, AFTER_A = range(4)
ROLES, FINE, GONE, CUT = "suax", 0, 1, 2
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
STEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL = {"su", "ua", "au"}
LEAF = 64                      # characters up to which a rope is kept written out
PRIME = (1 << 61) - 1


class Rope:
    """A string that may be two ropes behind each other, with its length and a code of its characters."""

    __slots__ = ("n", "text", "left", "right", "code", "power")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.n, self.code, self.power = len(text), int.from_bytes(text.encode(), "big") % PRIME, pow(256, len(text), PRIME)
        else:
            self.n, self.power = left.n + right.n, left.power * right.power % PRIME
            self.code = (left.code * right.power + right.code) % PRIME

    def __add__(self, other: Rope) -> Rope:
        if not other.n:
            return self
        if not self.n:
            return other
        if self.n + other.n <= LEAF:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def prefix(self, k: int) -> int:
        """The code of the first ``k`` characters."""
        code, at = 0, self
        while at.text is None:
            if k >= at.left.n:
                code = (code * at.left.power + at.left.code) % PRIME
                k, at = k - at.left.n, at.right
            else:
                at = at.left
        part = at.text[:k]
        return (code * pow(256, len(part), PRIME) + int.from_bytes(part.encode(), "big")) % PRIME

    def __lt__(self, other: Rope) -> bool:
        if self.text is not None and other.text is not None:
            return self.text < other.text
        low, high = 0, min(self.n, other.n)       # the longest common prefix is from low to high long
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix(middle) == other.prefix(middle):
                low = middle
            else:
                high = middle - 1
        return self.n < other.n if low == min(self.n, other.n) else self.at(low) < other.at(low)

    def at(self, k: int) -> str:
        node = self
        while node.text is None:
            k, node = (k - node.left.n, node.right) if k >= node.left.n else (k, node.left)
        return node.text[k]

    def __str__(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if node.text is not None:
                parts.append(node.text)
            else:
                todo += [node.right, node.left]
        return "".join(parts)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest way through ``a`` and then ``b`` for each pair of states; equal costs: the smaller audit."""
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            then = b.get((k, j))
            if then is None:
                continue
            total, old = cost + then[0], out.get((i, j))
            if old is None or total <= old[0]:
                joined = audit + then[1]
                if old is None or total < old[0] or joined < old[1]:
                    out[i, j] = (total, joined)
    return out


def _inserts() -> Matrix:
    """No, one or two inserted turns: any state that inserts can reach is two away at most."""
    stay: Matrix = {(i, i): (0, Rope("")) for i in range(4)}
    one = stay | {(i, j): (INSERT, Rope("I")) for (i, role), j in STEPS.items() if role != "s"}
    return product(one, one)


INSERTS = _inserts()


def symbol(role: str, fault: int) -> int:
    return 3 * ROLES.index(role) + fault


def symbol_matrix(sym: int) -> Matrix:
    """Inserts, then one row kept, given another role or deleted."""
    role, fault = ROLES[sym // 3], sym % 3
    extra = TRUNCATED if fault == CUT else 0
    row: Matrix = {(i, i): (DELETE, Rope("D")) for i in range(4)}
    if fault != GONE:
        for (i, wanted), j in STEPS.items():
            if wanted == role:
                edit = (extra, Rope("K"))
            elif wanted != "s":
                edit = (REROLE + extra, Rope("R"))
            else:
                continue
            row[i, j] = edit
    return product(INSERTS, row)


def best(total: Matrix) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits from the start to an accepted end."""
    ends = product({(i, j): v for (i, j), v in total.items() if i == START}, INSERTS)
    cost, audit = min((ends[START, j] for j in (START, AFTER_A) if (START, j) in ends), key=lambda e: (e[0], e[1]))
    return cost, str(audit)


def compress(seqs: Sequence[np.ndarray], first: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: (rules, sequences); rule k is symbol ``first + k``. Ends when no pair occurs twice.

    A pass takes the most frequent pairs that share no symbol, so their places cannot overlap;
    in a run of one symbol every other place of the pair is taken.
    """
    rules: list[tuple[int, int]] = []
    text = np.concatenate([x for s in seqs for x in (np.asarray(s, np.int64), np.array([-1]))]) if len(seqs) else np.zeros(0, np.int64)
    while len(text) > 1:
        a, b = text[:-1], text[1:]
        span = first + len(rules) + 1
        pair = np.where((a >= 0) & (b >= 0), a * span + b, -1)
        same = np.flatnonzero((a == b) & (a >= 0))
        if len(same):                                  # of overlapping places: first, third, ... of a run
            begin = np.concatenate([[True], np.diff(same) > 1])
            run = np.maximum.accumulate(np.where(begin, np.arange(len(same)), 0))
            pair[same[(np.arange(len(same)) - run) % 2 == 1]] = -1
        found, count = np.unique(pair, return_counts=True)
        found, count = found[(found >= 0) & (count > 1)], count[(found >= 0) & (count > 1)]
        if not len(found):
            break
        taken, chosen = set(), []
        least = count.max() // 2
        for k in np.lexsort((found, -count)):
            x, y = divmod(int(found[k]), span)
            if count[k] >= max(2, least) and x not in taken and y not in taken:
                taken |= {x, y}
                chosen.append(int(found[k]))
        rules += [divmod(p, span) for p in chosen]
        chosen_at = np.array(chosen)
        rank = np.argsort(chosen_at)
        hit = np.flatnonzero(np.isin(pair, chosen_at))
        text[hit] = first + len(rules) - len(chosen) + rank[np.searchsorted(chosen_at[rank], pair[hit])]
        text = np.delete(text, hit + 1)
    ends = np.flatnonzero(text == -1)
    return rules, [text[i:j] for i, j in zip(np.concatenate([[0], ends[:-1] + 1]) if len(ends) else [], ends)]


def matrices(seqs: Sequence[np.ndarray]) -> Iterable[Matrix]:
    """The transfer matrix of every sequence (none empty), by way of one grammar for all of them."""
    terminals = 3 * len(ROLES)
    rules, short = compress(seqs, terminals)
    known = [symbol_matrix(s) for s in range(terminals)]
    for a, b in rules:
        known.append(product(known[a], known[b]))
    for s in short:
        yield reduce(product, [known[x] for x in s])
