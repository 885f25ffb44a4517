"""Operator 9: token counts by heap-and-linked-list byte-pair merging.

A text is cut into segments that no vocabulary piece can bridge.  Each distinct
segment starts as a linked list of characters; the adjacent pair whose merged
piece has the lowest rank is popped from a heap again and again.  The count is
the number of initial symbols minus the number of merges: identifiers are never
made.  A character outside the vocabulary counts as its UTF-8 bytes.

Defined results: a null text counts as empty, an empty text has 0 tokens; very
long texts and very long words cost n log n; rows are independent, so repeated
rows, ties and empty tables need no rule; columns other than ``doc_id`` and
``text`` are ignored.

The work is one map over the table without any shuffle.  Workers keep a bounded
cache of segment counts between batches.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches

#: Segments in each of the two generations that a worker remembers.
CACHE_SEGMENTS = 350_000
#: Longer segments are counted but not remembered.
CACHE_CHARS = 64
SPACE = "▁"
NO_SPLIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def by_script(pieces: list[str]) -> re.Pattern:
    """Cuts between letters and all else as well."""
    odd = "".join(sorted({c for p in pieces for c in p if not c.isalpha() and re.match(r"[^\W\d_]", c)}))
    letter = rf"[^\W\d_{re.escape(odd)}]"
    return re.compile(f"{SPACE}*{letter}+|{SPACE}*(?:(?!{letter})[^{SPACE}])+|{SPACE}+")


class Merger(dict):
    """Segment -> number of tokens, filled as segments are met."""

    def __init__(self, ranks: dict[str, int], most: int = CACHE_SEGMENTS):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.older: dict[str, int] = {}
        # The finer cut is used only if no piece of the vocabulary crosses it.
        fine = by_script(list(ranks))
        self.cut = fine if all(len(fine.findall(p)) == 1 for p in ranks) else NO_SPLIT
        if any(SPACE in p.lstrip(SPACE) for p in ranks):
            raise ValueError("a piece has a space after other characters")

    def __missing__(self, segment: str) -> int:
        n = self.older.pop(segment, None)
        if n is None:
            n = self.count_segment(segment)
        if len(segment) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[segment] = n
        return n

    def count_segment(self, segment: str) -> int:
        ranks = self.ranks
        symbols = list(segment)
        total = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        n = len(symbols)
        if n == 1:
            return total
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            r = ranks.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # A stale entry: one of the two symbols has been merged meanwhile.
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            total -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                r = ranks.get(symbols[i] + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = ranks.get(symbols[h] + symbols[i])
                if r is not None:
                    heapq.heappush(heap, (r, h, len(symbols[h]) + size))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def merger(model_file: str) -> Merger:
    """Normal pieces of a sentencepiece BPE model, best first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    plain.sort(key=lambda i: -sp.get_score(i))
    return Merger({sp.id_to_piece(i): r for r, i in enumerate(plain)})


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = merger(model_file)
        n_tokens = [m.count(t) if t else 0 for t in (x.as_py() for x in batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = one(batch)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), out.column(1)], names=["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, keep, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
