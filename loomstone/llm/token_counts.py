"""Token counts by byte-pair merging with a heap over a linked list.

Adjacent pairs wait in a heap by merge rank; the lowest is popped, its two symbols become one, and the new neighbours
are pushed. A piece's count is its initial symbols minus its merges: no token identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import ready, table

#: Fixed value: the byte-level pre-tokeniser's pattern, with white space as Unicode's property of that name.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces longer than this are not remembered; the memory of counted pieces is emptied at this many.
LONGEST_KEPT, MOST_KEPT = 48, 1_000_000

#: A Python worker serves many tasks: what it has counted for a tokenizer stays with it.
_loaded: dict = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PieceCounts(dict):
    """Piece -> tokens. A missing piece is counted and, if short, remembered."""

    def __init__(self, merges: list, specials: list[str]):
        super().__init__()
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.first = [number(s) for s in byte_symbols()]
        self.merge = {(number(a), number(b)): (rank, number(a + b)) for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges)}
        self.find = regex.compile(PIECES).findall
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    @classmethod
    def load(cls, definition: str) -> PieceCounts:
        """From the text of a byte-level BPE tokenizer file."""
        if definition not in _loaded:
            d = json.loads(definition)
            _loaded.clear()
            _loaded[definition] = cls(d["model"]["merges"], [t["content"] for t in d["added_tokens"]])
        return _loaded[definition]

    def __missing__(self, piece: str) -> int:
        n = self.count_piece(piece.encode())
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[piece] = n
        return n

    def count_piece(self, raw: bytes) -> int:
        symbol = [self.first[b] for b in raw]
        n = len(symbol)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merge, merged = self.merge, 0
        heap = [(m[0], i, m[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (m := merge.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has merged with another meanwhile
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            merged += 1
            if k >= 0:
                before[k] = i
                if m := merge.get((new, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merge.get((symbol[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbol[h], new))
        return n - merged

    def count(self, text: str) -> int:
        if self.specials is None:
            return sum(map(self.__getitem__, self.find(text)))
        n, at = 0, 0
        for m in self.specials.finditer(text):
            n += 1 + sum(map(self.__getitem__, self.find(text[at : m.start()])))
            at = m.end()
        return n + sum(map(self.__getitem__, self.find(text[at:] if at else text)))


def count_tokens(docs: DataFrame, definition: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    definition: the text of a byte-level BPE file; it goes to the executors as one broadcast of its fixed size.
    A special token's string within a text is one token. Null and empty texts have none. Rows stay apart and in place;
    extra columns are not read; an empty table gives an empty table.
    """
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(definition)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts.load(sent.value)
        for b in batches:
            n = np.fromiter((counts.count(t.as_py() or "") for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", "text", size).mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return count_tokens(table(spark, sf_dir, "documents"), f.read())
