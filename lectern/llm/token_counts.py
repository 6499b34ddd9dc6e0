"""Token counts under a unigram segmentation, by dynamic programming over a trie.

A vocabulary file's ranks give its tokens a Zipf probability, 1 / (rank + 1) up
to a constant; a pre-token's segmentation is the likeliest one, of equals that
with the fewest tokens. Distinct pre-tokens are put in byte order, in which a
trie's depth-first walk meets them: the forward scores of a node, one for each
prefix, are computed once for all pre-tokens that share it, and a terminal node
stores its token count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import cut, read_ranks
from lectern.llm.common import bounded, extended, sliced, tidy

#: Units whose counts a worker keeps before it empties its table.
UNIT_TABLE = 300_000

_counters: dict[tuple[str, str], Counter] = {}


def scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Cost of each token in millionths of a nat; whole numbers, so that ties are exact."""
    return {t: round(1e6 * math.log(r + 1)) + 1_000_000 for t, r in ranks.items()}


class Counter:
    """Counts of one vocabulary; a process keeps one for each file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.cost = scores(read_ranks(path))
        self.longest = max(map(len, self.cost))
        # for each last two bytes, the lengths of tokens that end so, for fewer fruitless lookups
        lengths: dict[bytes, set[int]] = {}
        for t in self.cost:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {k: tuple(sorted(v)) for k, v in lengths.items()}
        self.find = regex.compile(pattern).findall
        self.units: dict[str, tuple[int, int]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Counter:
        if (path, pattern) not in _counters:
            _counters[path, pattern] = cls(path, pattern)
        return _counters[path, pattern]

    def terminal_counts(self, pretokens: list[bytes]) -> dict[bytes, int]:
        """Token count of each distinct pre-token."""
        cost, lengths = self.cost, self.lengths
        best, count = [0], [0]  # forward scores and counts along the current path of the trie
        out, last = {}, b""
        for p in sorted(set(pretokens)):
            shared, most = 0, min(len(p), len(last))
            while shared < most and p[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(p) + 1):
                c = cost[p[end - 1 : end]] + best[end - 1]
                k = count[end - 1] + 1
                for n in lengths.get(p[end - 2 : end], ()) if end > 1 else ():
                    if n > end:
                        break
                    t = cost.get(p[end - n : end])
                    if t is not None:
                        x = t + best[end - n]
                        if x < c or x == c and count[end - n] + 1 < k:
                            c, k = x, count[end - n] + 1
                best.append(c)
                count.append(k)
            out[p] = count[-1]
            last = p
        return out

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.units) > UNIT_TABLE:
            self.units.clear()
        parts = [cut(t) if t else [""] for t in texts]
        fresh = {" " + p for c in parts for p in c[1:] if p not in self.units}
        split = {u: [m.encode() for m in self.find(u)] for u in fresh.union(c[0] for c in parts)}
        known = self.terminal_counts([m for own in split.values() for m in own])
        counts = {u: (len(own), sum(map(known.__getitem__, own))) for u, own in split.items()}
        for u in fresh:
            self.units[u[1:]] = counts[u]
        out = []
        for c in parts:
            own = [counts[c[0]], *map(self.units.__getitem__, c[1:])]
            out.append((sum(a for a, _ in own), sum(b for _, b in own)))
        return out


def _drop() -> None:
    for counter in _counters.values():
        counter.units.clear()


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens (long) of each row of docs (doc_id, text; other columns are ignored).

    Pre-tokens are the matches of the pattern in the whole text. A null or
    empty text has none. A row is returned for each input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(ranks_path, pattern)
        for part, texts in sliced(batches):
            got = counter.count(texts)
            yield extended(part, ["doc_id"], n_pretokens=pa.array([a for a, _ in got], pa.int64()), n_tokens=pa.array([b for _, b in got], pa.int64()))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded(docs).mapInArrow(tidy(run, _drop), "doc_id long, n_pretokens long, n_tokens long")
