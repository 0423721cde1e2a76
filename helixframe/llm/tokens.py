"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made.

The vocabulary of a sentencepiece BPE model gives each mergeable piece a rank. A text is
its symbols (code points, spaces as U+2581, one put in front); again and again the adjacent
pair of lowest rank, leftmost among equals, is popped from a heap and merged in a linked
list. The count is the initial symbols less the merges, where a code point that the
vocabulary lacks counts as its UTF-8 bytes (byte fallback).

No merge can cross a place whose two code points are adjacent in no piece, so texts are cut
there and the counts of short parts are remembered for each Python worker.
"""

from __future__ import annotations

import sys
import types
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Parts remembered by a worker at most, and the longest part that is remembered; common
#: parts come early, so a full memory keeps them and rarer ones are counted anew each time.
CACHE_PARTS, CACHE_LENGTH = 700_000, 48
_SPACE = "▁"


class PieceCounter(dict):
    """Maps a space-separated part of a text to its number of tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank, self.joined, self.single = {}, set(), set()
        for i in range(sp.vocab_size()):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            if len(piece) == 1:
                self.single.add(piece)
            else:
                self.rank[piece] = -sp.get_score(i)
                self.joined.update(map("".join, zip(piece, piece[1:])))
        # a piece with a space mark after another code point would join words
        self.words_part = not any(len(p) > 1 and p[1] == _SPACE and p[0] != _SPACE for p in self.joined)
        self.lines_part = not any("\n" in p for p in self.joined)
        self.parts: dict[str, int] = {}

    def merged(self, symbols: str) -> int:
        """Tokens of one run of symbols: initial symbols less merges."""
        rank, single = self.rank, self.single
        sym = list(symbols)
        n = len(sym)
        cost = [1 if c in single else len(c.encode("utf-8", "surrogatepass")) for c in sym]
        total = sum(cost)
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        if not heap:
            return total
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, j, size = heappop(heap)
            left, right = sym[i], sym[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has changed since
            sym[i], sym[j] = left + right, ""
            total -= cost[i] + cost[j] - 1
            cost[i] = 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(sym[i] + sym[k])
                if r is not None:
                    heappush(heap, (r, i, k, len(sym[i]) + len(sym[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] + sym[i])
                if r is not None:
                    heappush(heap, (r, h, i, len(sym[h]) + len(sym[i])))
        return total

    def run(self, symbols: str) -> int:
        """Tokens of symbols, cut where no piece can join them."""
        joined, parts, total, at = self.joined, self.parts, 0, 0
        for i in range(1, len(symbols) + 1):
            if i == len(symbols) or symbols[i - 1:i + 1] not in joined:
                part = symbols[at:i]
                c = parts.get(part)
                if c is None:
                    c = self.merged(part)
                    if len(part) <= CACHE_LENGTH and len(parts) < CACHE_PARTS:
                        parts[part] = c
                total += c
                at = i
        return total

    def __missing__(self, word: str) -> int:
        # a word that follows a line end has no space mark before it
        c = self.run(word if word[:1] == "\n" else _SPACE + word)
        if len(word) <= CACHE_LENGTH and len(self) < CACHE_PARTS:
            self[word] = c
        return c

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.words_part and self.lines_part and _SPACE not in text:
            words = text.replace("\n", " \n").split(" ")
            # an empty word is a run of spaces, which pieces may join
            if "" not in words:
                return sum(map(self.__getitem__, words))
        marked = _SPACE + text.replace(" ", _SPACE)
        if not self.words_part:
            return self.run(marked)
        total, at, n = 0, 0, len(marked)
        while at < n:
            end = at
            while end < n and marked[end] == _SPACE:
                end += 1
            end = marked.find(_SPACE, end)
            end = n if end < 0 else end
            total += self.run(marked[at:end])
            at = end
        return total


def counter(model_path: str) -> PieceCounter:
    """The counter of this process; worker processes keep theirs from task to task."""
    kept = sys.modules.setdefault("_helixframe_counters", types.ModuleType("_helixframe_counters"))
    if not hasattr(kept, "by_path"):
        kept.by_path = {}
    if model_path not in kept.by_path:
        kept.by_path[model_path] = PieceCounter(model_path)
    return kept.by_path[model_path]


def _count(model_path: str, limit: int):
    def run(batches):
        pieces = counter(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                text = part.column(1)
                tokens = np.fromiter((pieces.count(t) if t else 0 for t in text.to_pylist()), np.int64, len(text))
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is empty: no bytes, no tokens. Nothing is shuffled; repeated rows and
    null doc_ids are rows like others; other columns of ``docs`` are not looked at.
    """
    rows = docs.selectExpr("doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_count(model_path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
