"""Re-Pair grammars of many sequences at once, and phrase grammars that do not depend on the file they are found in.

Both replace pairs of neighbouring symbols by rules, round after round, vectorised over a whole batch of sequences. In
a round every pair that beats the pairs it overlaps with is replaced: ``infer`` ranks pairs by how often they occur in
their sequence (Re-Pair), ``phrases`` by a hash of what they stand for, so equal text is parsed into equal rules
wherever it stands, and rules can be compared across repositories.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes; their order counts."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x632BE59BD9B4E019))


class Grammars(NamedTuple):
    length: np.ndarray  # tokens of each sequence
    start: np.ndarray  # symbols left in the start rule
    rules: np.ndarray  # rules with two or more uses
    bits: np.ndarray  # estimated size of the grammar, entropy-coded
    plain_bits: np.ndarray  # the same for the sequence without rules

    @property
    def size(self) -> np.ndarray:
        return self.start + 2 * self.rules


def _entropy_bits(sym: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Per sequence: its length times the order-0 entropy of its symbols, in bits."""
    if not len(sym):
        return np.zeros(count)
    order = np.lexsort((sym, doc))
    s, d = sym[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
    at = np.flatnonzero(new)
    freq = np.diff(np.r_[at, len(s)])
    total = np.bincount(doc, minlength=count).astype(float)
    out = np.zeros(count)
    np.add.at(out, d[at], freq * np.log2(total[d[at]] / freq))
    return out


def infer(seqs: list[np.ndarray]) -> Grammars:
    """A Re-Pair grammar for each sequence of small non-negative integers; rules are never shared between sequences."""
    count = len(seqs)
    length = np.array([len(s) for s in seqs], dtype=np.int64)
    rules = np.zeros(count, dtype=np.int64)
    if not length.sum():
        zero = np.zeros(count)
        return Grammars(length, length.copy(), rules, zero, zero.copy())
    sym = np.concatenate([np.asarray(s, dtype=np.int64) for s in seqs])
    doc = np.repeat(np.arange(count, dtype=np.int64), length)
    content = mix(sym)  # what each symbol stands for: ties are broken by it, so a sequence's grammar depends on nothing beside it
    plain = _entropy_bits(sym, doc, count)
    alphabet = np.array([len(np.unique(s)) if len(s) else 1 for s in seqs], dtype=float)
    top = int(sym.max()) + 1
    active = np.ones(count, dtype=bool)
    done_sym, done_doc = [], []
    while len(sym) > 1:
        inside = doc[1:] == doc[:-1]
        key = (doc[:-1] * top + sym[:-1]) * top + sym[1:]
        key = np.where(inside, key, -1 - np.arange(len(key)))
        _, inverse, freq = np.unique(key, return_inverse=True, return_counts=True)
        n = np.where(inside, freq[inverse], 0)
        both = combine(content[:-1], content[1:])
        rank = (n.astype(np.uint64) << np.uint64(40)) | (both >> np.uint64(24))
        rank[n < 2] = 0
        same = np.r_[False, key[1:] == key[:-1]]
        at = np.arange(len(key))
        run = np.maximum.accumulate(np.where(same, 0, at))
        left, right = np.r_[np.uint64(0), rank[:-1]], np.r_[rank[1:], np.uint64(0)]
        chosen = (rank > 0) & (rank >= left) & (rank >= right) & ((at - run) % 2 == 0)
        uses = np.bincount(inverse[chosen], minlength=len(freq))
        chosen &= uses[inverse] >= 2
        pos = np.flatnonzero(chosen)
        if not len(pos):
            break
        kinds, new = np.unique(inverse[pos], return_inverse=True)
        first = np.full(len(kinds), len(key), dtype=np.int64)
        np.minimum.at(first, new, pos)
        rules += np.bincount(doc[first], minlength=count)
        sym[pos] = top + new
        content[pos] = both[pos]
        keep = np.ones(len(sym), dtype=bool)
        keep[pos + 1] = False
        progressed = np.zeros(count, dtype=bool)
        progressed[doc[pos]] = True
        top += len(kinds)
        sym, doc, content = sym[keep], doc[keep], content[keep]
        stuck = active & ~progressed
        if stuck.any():  # sequences without a pair left are set aside
            aside = stuck[doc]
            done_sym.append(sym[aside])
            done_doc.append(doc[aside])
            sym, doc, content = sym[~aside], doc[~aside], content[~aside]
            active &= progressed
        if len(sym):
            _, sym = np.unique(sym, return_inverse=True)
            sym = sym.astype(np.int64)
            top = int(sym.max()) + 1
    sym = np.concatenate([*done_sym, sym])
    doc = np.concatenate([*done_doc, doc])
    start = np.bincount(doc, minlength=count)
    bits = _entropy_bits(sym, doc, count) + rules * 2 * np.log2(np.maximum(2, alphabet + rules))
    return Grammars(length, start, rules, bits, plain)


def phrases(seqs: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, rule, tokens): the rules of locally consistent grammars at the first round in which they stand for at
    least ``least`` tokens; a sequence that shrinks to one symbol earlier gives that symbol.

    ``seqs`` hold 64-bit token hashes. A rule's identity is the hash of its expansion, its choice depends only on the
    symbols next to it: text copied elsewhere gives the same rules but for those at its edges.
    """
    length = np.array([len(s) for s in seqs], dtype=np.int64)
    empty = np.zeros(0, dtype=np.int64)
    if not length.sum():
        return empty, np.zeros(0, dtype=np.uint64), empty.copy()
    sym = np.concatenate([np.asarray(s, dtype=np.uint64) for s in seqs])
    doc = np.repeat(np.arange(len(seqs), dtype=np.int64), length)
    weight = np.ones(len(sym), dtype=np.int64)
    while len(sym) > 1:
        inside = (doc[1:] == doc[:-1]) & (weight[1:] < least) & (weight[:-1] < least)
        if not inside.any():
            break
        key = combine(sym[:-1], sym[1:])
        rank = np.where(inside, key | np.uint64(1), np.uint64(0))
        same = np.r_[False, (rank[1:] == rank[:-1]) & inside[1:]]
        at = np.arange(len(rank))
        run = np.maximum.accumulate(np.where(same, 0, at))
        left, right = np.r_[np.uint64(0), rank[:-1]], np.r_[rank[1:], np.uint64(0)]
        chosen = inside & (rank >= left) & (rank >= right) & ((at - run) % 2 == 0)
        pos = np.flatnonzero(chosen)
        sym[pos] = key[pos]
        weight[pos] += weight[pos + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[pos + 1] = False
        sym, doc, weight = sym[keep], doc[keep], weight[keep]
    return doc, sym, weight
