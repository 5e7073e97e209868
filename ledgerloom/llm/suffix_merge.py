"""Front-coded sorted runs of suffixes, and their merge by a loser tree that knows common prefixes (used by operator 7).

A run is a list of byte strings in order, each stored as the length of the prefix it shares with the one
before it and the rest. In the tree every waiting string keeps the length of its common prefix with the
string that was last written. Of two such strings the one with the longer common prefix is the smaller;
only when both lengths are equal are bytes compared, and then from that length on. So no byte of a known
prefix is read again, and the merged run's common prefixes fall out of the merge.
"""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of a and b, known to be start or more."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    low, high = start, end
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def front_code(run: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """(shared lengths, all rests joined, lengths of the rests) of a sorted run."""
    shared, rests = [], []
    last = b""
    for s in run:
        n = common_prefix(last, s)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return shared, b"".join(rests), [len(r) for r in rests]


class Run:
    """Reads a front-coded run: text is the string at the head, shared its common prefix with the last string written."""

    def __init__(self, shared: list[int], rests: bytes, lengths: list[int]) -> None:
        self.coded, self.rests, self.lengths = shared, rests, lengths
        self.at, self.place, self.text, self.shared = -1, 0, b"", 0
        self.done = False
        self.advance()

    def advance(self) -> None:
        """To the next string. The one before it was written last, so the coded length is the one to keep."""
        self.at += 1
        if self.at == len(self.coded):
            self.done = True
            return
        n = self.lengths[self.at]
        self.shared = self.coded[self.at]
        self.text = self.text[: self.shared] + self.rests[self.place : self.place + n]
        self.place += n


def beats(x: Run, y: Run) -> bool:
    """Whether x goes before y; the loser's shared length is then the one with the winner."""
    if x.done or y.done:
        return y.done
    if x.shared != y.shared:
        return x.shared > y.shared
    n = common_prefix(x.text, y.text, x.shared)
    first = x.text[n:] <= y.text[n:]
    if first:
        y.shared = n
    else:
        x.shared = n
    return first


def merge(runs: list[Run]) -> list[tuple[int, int, int]]:
    """(run, place in the run, common prefix with the string before) of all strings in order."""
    size = 1
    while size < len(runs):
        size *= 2
    padded = runs + [Run([], b"", []) for _ in range(size - len(runs))]
    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if not beats(padded[a], padded[b]):
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1) if size > 1 else 0
    out = []
    while not padded[winner].done:
        run = padded[winner]
        out.append((winner, run.at, run.shared))
        run.advance()
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if not beats(padded[winner], padded[other]):
                losers[node], winner = winner, other
            node //= 2
    return out
