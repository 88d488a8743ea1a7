"""Token counts by a linear longest-match automaton.

A word, with a blank in front, is cut greedily into the longest pieces of a vocabulary. The
automaton is a trie of the pieces with failure links: where no piece goes on, the link leads to
the state for what is left after the pieces already certain, and their number, computed
beforehand, is added. So each byte is read once, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilog.llm import common

#: Words whose lengths a task remembers before it forgets them all.
REMEMBERED = 1 << 18


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file with a base64 piece and a rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """The automaton over the bytes of the pieces.

    A state is a prefix of some piece. ``fail[s]`` and ``popped[s]``: after the longest pieces that
    cut the state's bytes as far as certain, the state for the rest and the number of pieces. -1
    means that the bytes cannot be cut.
    """

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            state = 0
            for byte in piece:
                if byte not in self.next[state]:
                    self.next[state][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                state = self.next[state][byte]
            ends[state] = ends[state] or bool(piece)
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for byte, state in self.next[parent].items():
                todo.append(state)
                if ends[state]:
                    self.fail[state], self.popped[state] = 0, 1
                    continue
                count, rest = self.popped[parent], self.fail[parent]
                while rest >= 0 and byte not in self.next[rest]:
                    count, rest = count + self.popped[rest], self.fail[rest]
                if rest >= 0:
                    self.fail[state], self.popped[state] = self.next[rest][byte], count

    def length(self, word: bytes) -> int:
        """Number of pieces of the greedy cut; 1 (one unknown) if there is none."""
        follow, fail, popped = self.next, self.fail, self.popped
        state = count = 0
        for byte in word:
            while byte not in follow[state]:
                count += popped[state]
                state = fail[state]
                if state < 0:
                    return 1
            state = follow[state][byte]
        while state > 0:
            count += popped[state]
            state = fail[state]
        return count if state == 0 else 1


def count_tokens(docs: DataFrame, pieces: list[bytes], text: str = "text") -> DataFrame:
    """Append ``n_tokens``: the pieces of all words, which blanks (0x20, 0x09-0x0D) separate.

    A word that the vocabulary cannot cut is one token. Null and blank texts have none. The
    vocabulary is broadcast; it is a given file of fixed size. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def start() -> tuple[LongestMatch, dict[bytes, int]]:
        return LongestMatch(shared.value), {}

    def compute(state: tuple[LongestMatch, dict[bytes, int]], column: pa.Array) -> list[pa.Array]:
        automaton, lengths = state
        totals = [_total(raw, automaton, lengths) for raw in _rows(column)]
        return [pa.array(totals, pa.int64())]

    field = T.StructField("n_tokens", T.LongType(), False)
    return common.with_arrow_columns(docs, [text], [field], compute, start)


def _rows(column: pa.Array) -> Iterator[bytes]:
    data, offsets = common.as_bytes(column)
    raw = memoryview(data)
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(raw[first:last])


def _total(raw: bytes, automaton: LongestMatch, lengths: dict[bytes, int]) -> int:
    words = raw.split()
    if len(lengths) > REMEMBERED:
        lengths.clear()
    for word in set(words).difference(lengths):
        lengths[word] = automaton.length(b" " + word)
    return sum(map(lengths.__getitem__, words))
