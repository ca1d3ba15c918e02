"""Re-Pair grammars of many token sequences at once.

Re-Pair replaces the most frequent pair of neighbouring symbols of a sequence by
a new rule until no pair occurs twice. Here all sequences of a batch are worked
on together in flat arrays, and each round replaces, in every sequence, all
pairs whose count is greatest among the pairs they overlap; so a batch takes a
few rounds of sorting instead of one round for each rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Grammars:
    """For each sequence: tokens, symbols left in the start rule, rules, and tokens covered by long rules that are used again."""

    tokens: np.ndarray
    left: np.ndarray
    rules: np.ndarray
    reused: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def infer(sequences: list[np.ndarray], long_rule: int = 16) -> Grammars:
    """Grammars of the sequences; symbols are non-negative integers. Every round shortens the sequences or is the last."""
    n = len(sequences)
    tokens = np.array([len(s) for s in sequences], np.int64)
    symbol = np.concatenate([np.asarray(s, np.uint64) for s in sequences]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), tokens)
    size = np.ones(len(symbol), np.int64)
    symbol = _mix(symbol + np.uint64(1))
    rules = np.zeros(n, np.int64)
    # tokens covered by rules are tracked by position of the token sequence: a token is reused once a long rule over it was used twice
    begins = np.arange(len(symbol))
    covered = np.zeros(len(symbol) + 1, np.int64)
    while len(symbol) > 1:
        same = owner[1:] == owner[:-1]
        pair = np.where(same, _mix(symbol[:-1] * np.uint64(3) + _mix(symbol[1:])) ^ _mix(owner[1:].astype(np.uint64) + np.uint64(7)), np.uint64(0))
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        weight = np.where(same, count[back], 0).astype(np.float64)
        weight += back / (len(count) + 1.0)  # equal counts: a fixed order of the pairs
        good = same & (weight >= 2)
        before = np.r_[0.0, weight[:-1]]
        after = np.r_[weight[1:], 0.0]
        # equal neighbours are overlapping copies of one pair: every other one of the run
        pick = good & (weight >= before) & (weight >= after)
        run = pick & np.r_[False, pick[:-1]] & (weight == before)
        if run.any():
            start = np.flatnonzero(pick & ~run)
            nth = np.arange(len(pick)) - start[np.maximum(np.searchsorted(start, np.arange(len(pick)), side="right") - 1, 0)]
            pick &= nth % 2 == 0
        at = np.flatnonzero(pick)
        ids, inv, used = np.unique(pair[at], return_inverse=True, return_counts=True)
        at = at[used[inv] >= 2]
        if not len(at):
            break
        first = np.unique(pair[at], return_index=True)[1]
        np.add.at(rules, owner[at[first]], 1)
        symbol[at] = pair[at]
        merged = size[at] + size[at + 1]
        size[at] = merged
        long = merged >= long_rule
        np.add.at(covered, begins[at[long]], 1)
        np.add.at(covered, begins[at[long]] + merged[long], -1)
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, owner, size, begins = symbol[keep], owner[keep], size[keep], begins[keep]
    left = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    inside = np.cumsum(covered[:-1]) > 0
    reused = np.bincount(np.repeat(np.arange(n), tokens), weights=inside, minlength=n).astype(np.int64) if len(inside) else np.zeros(n, np.int64)
    return Grammars(tokens, left, rules, reused)


def shared_rules(sequences: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """The rules of each sequence that stand for ``least`` tokens or more, as numbers that are the same wherever the same tokens stand.

    Re-Pair picks pairs by their frequency in one sequence, so a text copied into another would get other rules there. Here a pair is
    replaced where its hash is smaller than those of the pairs it overlaps: what becomes a rule is decided by the tokens around it alone.
    Rules that are long enough are not paired further, so a sequence falls into rules of ``least`` to about twice as many tokens.
    """
    n = len(sequences)
    tokens = np.array([len(s) for s in sequences], np.int64)
    symbol = _mix(np.concatenate([np.asarray(s, np.uint64) for s in sequences]) + np.uint64(1)) if n else np.zeros(0, np.uint64)
    owner, size = np.repeat(np.arange(n), tokens), np.ones(len(symbol), np.int64)
    top = np.uint64(2**64 - 1)
    while len(symbol) > 1:
        pair = _mix(symbol[:-1] * np.uint64(3) + _mix(symbol[1:]))
        pair[(owner[1:] != owner[:-1]) | (size[1:] >= least) | (size[:-1] >= least)] = top
        at = np.flatnonzero((pair < np.r_[top, pair[:-1]]) & (pair < np.r_[pair[1:], top]))
        if not len(at):
            break
        symbol[at] = pair[at]
        size[at] += size[at + 1]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, owner, size = symbol[keep], owner[keep], size[keep]
    long = size >= least
    return np.split(symbol[long].view(np.int64), np.cumsum(np.bincount(owner[long], minlength=n))[:-1]) if n else []
