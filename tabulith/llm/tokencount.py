"""Token counts of a SentencePiece byte-pair model, without making identifiers.

A chunk of text is a doubly linked list of symbols and a heap of adjacent pairs
that are pieces; the pair of least rank (leftmost first) is merged until the heap
is empty. Each merge takes one symbol away, so the count is the initial symbols
minus the merges, where a character that is no piece counts as its UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tabulith.llm.common import map_arrow, strings

SPACE = "▁"
#: Most chunks whose counts a Python worker remembers; when full it starts afresh.
CACHED = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of one protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else 4 if wire == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """The pieces and normaliser settings of a ``.model`` file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            top = list(_fields(file.read()))
        scores: dict[str, float] = {}
        kinds: set[int] = set()
        for number, body in top:
            if number == 1:
                piece = dict(_fields(body))
                kind = piece.get(3, 1)
                kinds.add(kind)
                if kind == 1:
                    scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
        trainer = dict(_fields(next((b for n, b in top if n == 2), b"")))
        normaliser = dict(_fields(next((b for n, b in top if n == 3), b"")))
        if trainer.get(3) != 2 or not trainer.get(35) or kinds - {1, 2, 3, 6}:
            raise ValueError("only byte-pair models with byte fallback and without user-defined pieces are supported")
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only the identity normaliser that keeps all spaces is supported")
        self.prefix = SPACE if normaliser.get(3, 1) else ""
        levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: piece -> rank; equal scores share a rank, then the leftmost pair goes first
        self.rank = {p: levels[s] for p, s in scores.items()}
        inside = {c for p in scores if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece has a space after another character; chunks can't be cut before spaces")
        # no merge crosses a character that no longer piece contains, nor a place before a space
        alone = "".join(sorted(c for c in "\t\n\v\f\r" if c not in inside))
        body = f"[^{SPACE}{alone}]"
        self.chunk = re.compile(f"{SPACE}*{body}+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    def count_chunk(self, chunk: str) -> int:
        """Tokens of one chunk by heap and linked list."""
        rank = self.rank
        symbols: list[str | None] = list(chunk)
        size = len(symbols)
        total = sum(1 if c in rank else len(c.encode("utf-8", "replace")) for c in symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []
        for i in range(size - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= size or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            total -= 1
            if k < size:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(heap, (rank[new], i, new))
            if (h := before[i]) >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(heap, (rank[new], h, new))
        return total


class Counter:
    """Counts whole texts; remembers the counts of at most CACHED chunks."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.known: dict[str, int] = _Remember(self.model)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > CACHED:
            self.known.clear()
        whole = self.model.prefix + text.replace(" ", SPACE)
        return sum(map(self.known.__getitem__, self.model.chunk.findall(whole)))


class _Remember(dict):
    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> int:
        n = self.model.count_chunk(chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each model file in a worker."""
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Reads ``doc_id`` and ``text``, whatever else is there; null and empty texts have 0
    bytes and 0 tokens; repeated rows are counted each; no shuffle, one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_path)
        for batch in batches:
            sizes, n = [], []
            for text in strings(batch.column("text")):
                sizes.append(len(text.encode()))
                n.append(tokens(text))
            made = [sizes, n, [x > limit for x in n]]
            kinds = [pa.int64(), pa.int64(), pa.bool_()]
            columns = [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(made, kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
