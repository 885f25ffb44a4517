"""Operator 7: byte-level BPE encoding and decoding by a prefix-sharing trie.

Distinct words of a batch form a trie.  The encoding of every prefix of a word
ends in exactly one token, and that token alone, with the state of the prefix
before it, fixes the whole encoding.  A depth-first walk therefore carries one
last token for each byte on the current path, and a prefix that many words
share is encoded once.  Sorted words are the trie in depth-first order: the
path is cut back to the common prefix with the word before and then extended,
so no nodes are stored.

A token may follow another if byte-pair merging of their joined bytes would
leave the border between them alone; this is decided by undoing their merges
from the latest to the earliest.

Decoding joins the bytes of each id of a text's whole sequence.

Defined results: a null text counts as empty and gives no ids; a special token's
string inside a text becomes its id, as the file's own library has it by
default; rows are independent; extra columns are ignored.  One map, no shuffle,
and caches of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import map_batches

#: Words in each of the two generations, and pairs of tokens, that a worker remembers.
CACHE_WORDS = 100_000
CACHE_PAIRS = 250_000
CACHE_CHARS = 64
#: Fixed value: how byte-level BPE files split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        byte = printable_bytes()
        raw = {t: bytes(byte[c] for c in t) for t in vocab if all(c in byte for c in t)}
        self.ids = {b: vocab[t] for t, b in raw.items()}  # bytes -> id
        self.bytes = {vocab[t]: b for t, b in raw.items()}
        # In what follows a token is its rank: single bytes first, then merges in order.
        rank = {b: i for i, b in enumerate(sorted((b for b in self.ids if len(b) == 1)))}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(len(rank))]
        self.pair: dict[int, int] = {}  # left << 32 | right -> joined
        for left, right in merges:
            a, b = raw[left], raw[right]
            rank[a + b] = len(self.split)
            self.pair[rank[a] << 32 | rank[b]] = rank[a + b]
            self.split.append((rank[a], rank[b]))
        self.rank = rank
        self.id_of_rank = [0] * len(self.split)
        for b, r in rank.items():
            self.id_of_rank[r] = self.ids[b]
        self.length = {r: len(b) for b, r in rank.items()}
        sizes: dict[bytes, set[int]] = {}  # last three bytes -> sizes of the tokens that end so
        for b in rank:
            sizes.setdefault(b[-3:], set()).add(len(b))
        self.sizes = {b: tuple(sorted(x | {2, 1}, reverse=True)) for b, x in sizes.items() if len(b) == 3}
        self.specials = specials
        self.bytes |= {i: s.encode() for s, i in specials.items()}
        self.bytes_of_name = {str(i): b for i, b in self.bytes.items()}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.words = regex.compile(PATTERN)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def forget(self) -> None:
        """Drops the older of the learned words; the newer ones and the pairs of tokens, which the next texts share, stay."""
        self.older = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of a and b gives a, b again."""
        left, right, limit = a, b, 1 << 60
        pair, split = self.pair, self.split
        while True:
            joined = pair.get(left << 32 | right)
            if joined is not None and joined < limit:
                ok = False
                break
            # Undo the later of the two merges; only its inner half can touch the border.
            if left > right:
                limit = left
                inner = split[left][1]
                if inner == left:  # a single byte: undo the other side
                    limit, inner = right + 1, split[right][0]
                    if inner == right:
                        ok = True
                        break
                    right = inner
                else:
                    left = inner
            else:
                limit = right + 1
                inner = split[right][0]
                if inner == right:
                    limit, inner = left, split[left][1]
                    if inner == left:
                        ok = True
                        break
                    left = inner
                else:
                    right = inner
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[a << 32 | b] = ok
        return ok

    def encode_sorted(self, words: list[bytes]):
        """The tokens of each word; ``words`` in byte order."""
        rank, sizes, length, may, fits = self.rank, self.sizes, self.length, self.may_follow, self.fits
        last: list[int] = []  # last[i]: last token of the path's first i + 1 bytes
        before = b""
        for word in words:
            common, n = 0, min(len(before), len(word))
            while common < n and before[common] == word[common]:
                common += 1
            del last[common:]
            for end in range(common + 1, len(word) + 1):
                for size in sizes.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    if size < end:
                        if (token := rank.get(word[end - size : end])) is not None:
                            previous = last[end - size - 1]
                            if (ok := fits.get(previous << 32 | token)) is None:
                                ok = may(previous, token)
                            if ok:
                                last.append(token)
                                break
                    elif size == end and (token := rank.get(word[:end])) is not None:
                        last.append(token)
                        break
            before = word
            out, at = [], len(word)
            while at:
                token = last[at - 1]
                out.append(token)
                at -= length[token]
            out.reverse()
            yield out

    def learn(self, words: set[str]) -> dict[str, str]:
        """Ids, joined by commas, of the given words that are not in ``known`` when it returns; the others are there."""
        known, older, out = self.known, self.older, {}
        words = [w for w in words if w not in known]
        if len(known) + len(words) > CACHE_WORDS:
            self.older = older = known
            self.known = known = {}
        fresh = []
        for w in words:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            else:
                fresh.append((w.encode(), w))
        fresh.sort()
        text_of = list(map(str, self.id_of_rank))
        for (_, w), tokens in zip(fresh, self.encode_sorted([b for b, _ in fresh]), strict=True):
            ids = ",".join([text_of[t] for t in tokens])
            if len(w) <= CACHE_CHARS and len(known) < CACHE_WORDS:
                known[w] = ids
            else:
                out[w] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if not self.at_special or not self.at_special.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m)
            at = m.end()
        return out + self.words.findall(text[at:])

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas, special ids included; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        return b"".join(map(self.bytes_of_name.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def encode(self, texts: list[str]) -> list[str]:
        """Ids, joined by commas, of each text."""
        cut = [self.pieces(t) for t in texts]
        words = {w for piece in cut for w in piece if isinstance(w, str)}
        extra = self.learn(words)
        known = self.known if not extra else None
        out = []
        for piece in cut:
            try:
                ids = [known[w] for w in piece]
            except (KeyError, TypeError):
                ids = [(self.known.get(w) or self.older.get(w) or extra[w]) if isinstance(w, str) else str(self.specials[w.group()]) for w in piece]
            out.append(",".join(ids))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Codec(model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


def decode(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(tokenizer_file)
        texts = [c.decode(",".join(map(str, ids or ()))) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", rows["ids"].cast("array<int>").alias("ids")), run, f"doc_id {id_type}, text string")


def encode(docs: DataFrame, tokenizer_file: str, chars: int = 2 << 20) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of each row; texts are taken in groups of about ``chars`` characters."""
    return _encode(docs, tokenizer_file, chars, digest=False)


def encode_digests(docs: DataFrame, tokenizer_file: str, chars: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, hashed beside the ids so that these need not leave the worker."""
    return _encode(docs, tokenizer_file, chars, digest=True)


def _encode(docs: DataFrame, tokenizer_file: str, chars: int, digest: bool) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(tokenizer_file)
        texts = [x.as_py() or "" for x in batch.column(1)]
        cols: list[list] = [[], [], []]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
                size += len(texts[to])
                to += 1
            for ids in c.encode(texts[at:to]):
                text = c.decode(ids)
                if digest:
                    cols[0].append(ids.count(",") + 1 if ids else 0)
                    cols[1].append(sha(ids.encode()))
                    cols[2].append(sha(text.encode()))
                else:
                    cols[0].append([int(i) for i in ids.split(",")] if ids else [])
                    cols[1].append(text)
            at = to
        if digest:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"doc_id {id_type}, ids array<int>, decoded string"
    return map_batches(rows, run, schema, done=lambda: codec(tokenizer_file).forget())
