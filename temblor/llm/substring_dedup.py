"""Operator 3: substring dedup with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one text; a window whose words
also start anywhere else is repeated, and the words that repeated windows
cover are removed.

Every window names an anchor, its smallest hash of ``ANCHOR`` words, so that
equal windows have equal anchors.  Anchors that occur once in the corpus cannot
belong to a repeated window.  For the others the texts give regions: runs of
windows with one anchor occurrence.  The regions of an anchor are a reference
shard; a shard's suffix automaton holds each distinct region with its number
of occurrences, regions are streamed through it, and the matching statistics at
each word, cut to ``WINDOW`` words, tell how often the window that ends there
occurs.  Words are compared, hashes only route.

Sending the automaton of every shard to every text, by broadcast, would read
the corpus once for each shard; here the shuffle brings a region to the only shard
that can hold its windows.  An anchor with more than ``SHARD`` regions has
several shards; what a shard alone does not find repeated is then counted
over the anchor's shards by the window's digest.  So no task holds more than
about ``SHARD`` regions of a key, and nothing is dropped.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; of repeated rows all lose their windows; windows are judged on the input
only; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, row_keys, stored
from .textkernel import Words, grams, slices, utf8

U64 = np.uint64
WINDOW = 35
ANCHOR = 10
SHARD = 1000


def window_anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window: its smallest anchor hash and the leftmost place of that."""
    value = grams(h, anchor)
    place = np.arange(len(value), dtype=np.int64)
    have, width = 1, window - anchor + 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[: len(value) - step]
        value = np.where(right, value[step:], value[: len(value) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        have += step
    return value, place


def runs_of_texts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: anchor hash and first window of each run of windows with one anchor occurrence, and the number of windows."""
    none = np.zeros(0, U64), np.zeros(0, np.int64), 0
    for a, b in slices(texts, 1 << 20):
        words = Words(*utf8(texts.slice(a, b - a)))
        if len(words.hash) < WINDOW:
            yield from [none] * (b - a)
            continue
        value, place = window_anchors(words.hash)
        for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
            windows = n - WINDOW + 1
            if windows < 1:
                yield none
                continue
            p = place[first : first + windows]
            start = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            yield value[first + start], start, windows


class Automaton:
    """Suffix automaton of several word sequences; ``count[state]`` is the number of places where the state's sequences end."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append({} if of is None else dict(self.next[of]))
        self.link.append(0 if of is None else self.link[of])
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of p's longest sequence and the word, parted from q."""
        clone = self._state(self.length[p] + 1, of=q)
        self.link[q] = clone
        nxt, link = self.next, self.link
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list[bytes], times: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # an earlier sequence has this prefix
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
            else:
                now, p = self._state(length[last] + 1), last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = now
                    p = link[p]
                if p < 0:
                    link[now] = 0
                else:
                    q = nxt[p][w]
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = now
            self.count[last] += times

    def close(self) -> None:
        """Counts of ends, summed from long to short."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def occurrences(self, words: list[bytes], window: int) -> list[int]:
        """How often each window of the words occurs: the matching statistics are cut to the window."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state, have, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            state = nxt[state].get(w, 0)
            have = have + 1 if state else 0
            while state and length[link[state]] >= window:
                state = link[state]
            have = min(have, length[state])
            if i >= window - 1:
                out.append(count[state] if have >= window else 0)
        return out


def judge_shard(regions: dict[bytes, list[tuple]], alone: bool) -> tuple[list[tuple], list[tuple]]:
    """Spans (row, first, end) of repeated windows, and windows left open (digest, times, row, first) if the shard is not alone.

    ``regions``: words joined by one space -> the rows (k1, k2, first window) that have them."""
    spans, pending = [], []
    if alone and len(regions) == 1:
        ((text, rows),) = regions.items()
        end = text.count(b" ") + 1
        if len(rows) > 1:  # only copies of one region
            return [(k1, k2, at, at + end) for k1, k2, at in rows], pending
        if end == WINDOW:
            return spans, pending
    a, cut = Automaton(), {text: text.split(b" ") for text in regions}
    for text, rows in regions.items():
        a.add(cut[text], len(rows))
    a.close()
    seen: set[bytes] = set()
    for text, rows in regions.items():
        words = cut[text]
        times = a.occurrences(words, WINDOW)
        i = 0
        while i < len(times):
            j = i
            while j < len(times) and times[j] > 1:
                j += 1
            if j > i:
                spans += [(k1, k2, at + i, at + j - 1 + WINDOW) for k1, k2, at in rows]
            i = max(j, i + 1)
        if not alone:
            for i, n in enumerate(times):
                digest = hashlib.blake2b(b" ".join(words[i : i + WINDOW]), digest_size=16).digest()
                if n == 1:
                    k1, k2, at = rows[0]
                    pending.append((digest, 1, k1, k2, at + i))
                elif digest not in seen:
                    seen.add(digest)
                    pending.append((digest, n, None, None, None))
    return spans, pending


def find_spans(docs: DataFrame) -> DataFrame:
    """k1, k2, first, end: spans of words (by number) that repeated windows cover, possibly overlapping."""
    keyed = docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = [], []
        for value, _, _ in runs_of_texts(batch.column(2)):
            v, n = np.unique(value.view(np.int64), return_counts=True)
            hashes.append(v)
            counts.append(n.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["k1", "k2", "a", "n"])

    met = map_batches(keyed, anchors, "k1 long, k2 long, a array<long>, n array<int>")
    met = met.select("k1", "k2", F.explode_outer(F.arrays_zip("a", "n")).alias("x")).select("k1", "k2", "x.a", "x.n").where("a is not null")
    often = met.groupBy("a").agg(F.sum("n").alias("total")).where("total > 1")
    marks = met.join(often, "a").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "total")).alias("marks"))
    marked = keyed.join(marks, ["k1", "k2"]).select("k1", "k2", "text", F.col("marks.a").alias("a"), F.col("marks.total").alias("total"))

    def regions(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        k1s, k2s = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, (value, start, windows) in enumerate(runs_of_texts(batch.column(2))):
            a = batch.column(3)[row].values.to_numpy().view(U64)
            total = batch.column(4)[row].values.to_numpy()
            order = np.argsort(a)
            a, total = a[order], total[order]
            at = np.minimum(np.searchsorted(a, value), len(a) - 1)
            hit = np.flatnonzero(a[at] == value)
            if not len(hit):
                continue
            words = batch.column(2)[row].as_py().encode().split()
            end = np.append(start[1:], windows)
            for r in hit.tolist():
                first, stop = int(start[r]), int(end[r])
                shards = -(-int(total[at[r]]) // SHARD)
                cols[0].append(int(value[r].view(np.int64)))
                cols[1].append(hash((k1s[row], k2s[row], first)) % shards if shards > 1 else -1)
                cols[2].append(k1s[row])
                cols[3].append(k2s[row])
                cols[4].append(first)
                cols[5].append(b" ".join(words[first : stop - 1 + WINDOW]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "shard", "k1", "k2", "first", "words"])

    routed = map_batches(marked, regions, "a long, shard int, k1 long, k2 long, first int, words binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: list[tuple], open_: list[tuple]) -> pa.RecordBatch:
            k1 = [x[0] for x in found] + [x[2] for x in open_]
            k2 = [x[1] for x in found] + [x[3] for x in open_]
            first = [x[2] for x in found] + [x[4] for x in open_]
            end = [x[3] for x in found] + [None if x[4] is None else x[4] + WINDOW for x in open_]
            digest = [None] * len(found) + [x[0] for x in open_]
            times = [None] * len(found) + [x[1] for x in open_]
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary()), pa.array(times, pa.int64())], names=["k1", "k2", "first", "end", "digest", "times"])

        key, held = None, {}
        spans, pending = [], []
        for batch in batches:
            for a, shard, k1, k2, first, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, shard) != key:
                    if held:
                        s, p = judge_shard(held, key[1] < 0)
                        spans += s
                        pending += p
                    key, held = (a, shard), {}
                held.setdefault(words, []).append((k1, k2, first))
            if len(spans) + len(pending) > 20_000:
                yield result(spans, pending)
                spans, pending = [], []
        if held:
            s, p = judge_shard(held, key[1] < 0)
            yield result(spans + s, pending + p)

    judged = stored(routed.repartition("a", "shard").sortWithinPartitions("a", "shard").mapInArrow(judge, "k1 long, k2 long, first int, end int, digest binary, times long"), "windows")
    open_ = judged.where("digest is not null")
    repeated = open_.groupBy("digest").agg(F.sum("times").alias("all")).where("all > 1")
    late = open_.where("times = 1").join(repeated, "digest").select("k1", "k2", "first", "end")
    return judged.where("digest is null").select("k1", "k2", "first", "end").unionByName(late)


def remove(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (or, without ``keep_text``, only their digest)."""
    spans = find_spans(docs).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text")).join(spans, ["k1", "k2"], "left")
    rows = rows.select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.end").alias("end"))
    last = "text" if keep_text else "kept_sha256"

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, out = [], [], []
        for text, first, end in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if first.is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first.values.to_numpy(), 1)
                np.add.at(edge, end.values.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept = b" ".join(words)
            out.append(kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, cut, f"doc_id {id_type}, n_words long, n_removed long, {last} string")
