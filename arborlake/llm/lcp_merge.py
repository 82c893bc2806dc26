"""Sorted runs of byte strings, front-coded, and their merge by an LCP-aware loser tree.

A front-coded string is the length of the prefix it shares with the string
before it and the rest.  The loser tree keeps, for every run's head, the prefix
it shares with the last string put out.  Of two heads the one with the longer
shared prefix is the smaller, without a look at the strings; only heads with
equal values are compared, from that length on.  So no known prefix is compared
again, and each output comes with the prefix it shares with the one before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

Item = tuple[int, bytes, Any]  # shared prefix with the one before, string, what it carries


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` at least."""
    end = min(len(a), len(b))
    step = 16
    while at < end and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= end:
        return end
    top = min(end, at + step)
    while at < top:  # the difference is in a[at:top], or the shorter one ends there
        mid = (at + top + 1) // 2
        if a[at:mid] == b[at:mid]:
            at = mid
        else:
            top = mid - 1
    return at


def sorted_run(items: Iterable[tuple[bytes, Any]]) -> list[Item]:
    out, before = [], b""
    for text, carried in sorted(items):
        out.append((common_prefix(before, text), text, carried))
        before = text
    return out


def front_code(run: list[Item]) -> tuple[list[int], list[bytes]]:
    return [n for n, _, _ in run], [text[n:] for n, text, _ in run]


def front_decode(shared: Iterable[int], rests: Iterable[bytes], carried: Iterable[Any]) -> Iterator[Item]:
    before = b""
    for n, rest, what in zip(shared, rests, carried, strict=True):
        before = before[:n] + rest
        yield n, before, what


def merge(runs: list[Iterator[Item]]) -> Iterator[Item]:
    """The strings of all runs in order, each with the prefix shared with the one before."""
    k = len(runs)
    if not k:
        return
    heads: list[Item | None] = [next(r, None) for r in runs]
    shared = [0] * k  # with the last string put out

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's value is then about the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None or shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        x, y = heads[a][1], heads[b][1]
        n = common_prefix(x, y, shared[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        winner, loser = (a, b) if first else (b, a)
        shared[loser] = n
        return winner, loser

    losers = [0] * k  # losers[0] is the winner of all

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    losers[0] = build(1) if k > 1 else 0
    while True:
        at = losers[0]
        head = heads[at]
        if head is None:
            return
        yield shared[at], head[1], head[2]
        heads[at] = following = next(runs[at], None)
        shared[at] = following[0] if following else 0
        node = (at + k) // 2
        while node:
            at, losers[node] = play(at, losers[node])
            node //= 2
        losers[0] = at
