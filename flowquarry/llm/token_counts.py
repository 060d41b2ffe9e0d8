"""Token counts without identifiers: byte-pair merging with a heap and a linked list.

A text is cut at the tokenizer's special strings (one token each) and, between them, by its
pre-tokenizer pattern. Each piece starts as one symbol per byte; the adjacent pair of lowest
rank (leftmost on ties) is popped from a heap and merged in a linked list until no pair has
a rank. The count is the number of initial symbols minus the number of merges.

A very long text takes time and memory in proportion to its longest piece.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); a null id stays a
row; repeated rows are counted each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from flowquarry.llm.common import map_rows, table

#: Pieces remembered per worker; the memory is emptied when full.
MEMORY = 1 << 19
#: Longer pieces are merged anew each time.
REMEMBERED_CHARS = 64
LIMIT = 512


def merge_symbols(symbols: list, join: Callable[[object, object], tuple | None]) -> int:
    """Merge adjacent symbols by rank until none can, in place; the number of merges.

    ``join`` gives (rank, merged) or None; a symbol joined to the one before it becomes None.

    The heap holds (rank, left position, left, right); an entry is stale when either symbol
    has changed since. ``after`` and ``before`` link the symbols that are left.
    """
    n, merges = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = join(symbols[i], symbols[i + 1])
        if found is not None:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapify(heap)
    while heap:
        _, i, left, right, merged = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = join(merged, symbols[k])
            if found is not None:
                heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = join(symbols[h], merged)
            if found is not None:
                heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return merges


def heap_merge(symbols: list, join: Callable[[object, object], tuple | None]) -> list:
    """The symbols left after all merges."""
    left = list(symbols)
    merge_symbols(left, join)
    return [s for s in left if s is not None]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Counter:
    """Counts tokens by the merges of a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.start = [ids[s] for s in byte_symbols()]
        self.pieces = regex.compile(pattern).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        start = [self.start[b] for b in piece.encode()]
        merges = self.merges
        n = len(start) - merge_symbols(start, lambda a, b: merges.get((a, b)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = n
        return n

    def __call__(self, text: str) -> int:
        known, total = self.known.get, 0
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            for piece in self.pieces(part):
                n = known(piece)
                total += self._piece(piece) if n is None else n
        return total


@functools.cache
def counter(path: str, pattern: str) -> Counter:
    """One per worker process, so that what it remembers serves later tasks too."""
    return Counter(path, pattern)


def token_counts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``path`` is read on each worker."""

    def make():
        count = counter(path, pattern)

        def work(ids, texts):
            out = []
            for i, t in zip(ids, texts):
                t = t or ""
                n = count(t)
                out.append((i, len(t.encode()), n, n > limit))
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df.select(id_col, text_col), make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json."""
    import public_tokenizers as public

    return token_counts(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)


QUERY = op9_token_counts
