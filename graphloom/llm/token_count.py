"""Token counts by byte-pair merging with a heap and a linked list.

For each piece, a heap holds adjacent pairs by rank and position and a linked list holds the live symbols. The
lowest rank is popped again and again; pops whose pair has changed are skipped. The count is the number of
initial symbols less the merges, so no ids are made.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BATCH_BYTES, BATCH_ROWS, CACHE_PIECES, CHUNK_CHARS
from .common import column, id_and_text, map_batches, texts
from .pairs import NO_RANK, PairTable, padded
from .pretokenize import splitter


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Counter:
    """Counts as the library for a byte-level tokenizer file gives them."""

    def __init__(self, tokenizer_file: bytes):
        spec = json.loads(tokenizer_file)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        odd = [k for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)] + ["use_regex"] * (spec["pre_tokenizer"].get("use_regex") is False)
        if odd:
            raise ValueError(f"not supported: {', '.join(sorted(set(odd)))}")
        self.prefix = " " if spec["pre_tokenizer"]["add_prefix_space"] else ""
        vocab = model["vocab"]
        self.first = [vocab[c] for c in byte_characters()]
        # pair -> rank and the symbol it makes; of equal pairs the later rank holds
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        keys, values = np.array(list(self.merges), np.int64), list(self.merges.values())
        self.rank = PairTable(keys >> 20, keys & 0xFFFFF, [rank for rank, _ in values])
        self.made = np.zeros(len(model["merges"]), np.int32)
        self.made[[rank for rank, _ in values]] = [symbol for _, symbol in values]
        self.bytes = np.array(self.first, np.int32)
        self.byte_pairs = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)
        self.cache: dict[str, int] = {}

    def piece(self, text: bytes) -> int:
        """Tokens of one piece."""
        first, merges = self.first, self.merges
        symbol = [first[b] for b in text]
        n = len(symbol)
        if n < 2:
            return n
        get = merges.get
        shift = n.bit_length()
        heap = []
        for i in range(n - 1):
            found = get(symbol[i] << 20 | symbol[i + 1])
            if found:
                heap.append(found[0] << shift | i)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask, merged = (1 << shift) - 1, 0
        while heap:
            top = heappop(heap)
            at = top & mask
            gone = after[at]
            if gone >= n or symbol[at] < 0:
                continue
            found = get(symbol[at] << 20 | symbol[gone])
            if not found or found[0] != top >> shift:
                continue
            made = symbol[at] = found[1]
            symbol[gone] = -1
            right, left = after[gone], before[at]
            after[at] = right
            merged += 1
            if right < n:
                before[right] = at
                found = get(made << 20 | symbol[right])
                if found:
                    heappush(heap, found[0] << shift | at)
            if left >= 0:
                found = get(symbol[left] << 20 | made)
                if found:
                    heappush(heap, found[0] << shift | left)
        return n - merged

    def pieces(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece; pieces of about the same length share arrays, one heap in each row."""
        out = [0] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) < 2:
                out[i] = len(piece)
            elif len(piece) > BATCH_BYTES:
                out[i] = self.piece(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            for start in range(0, len(rows), BATCH_ROWS):
                part = rows[start : start + BATCH_ROWS]
                for i, count in zip(part, self._together([pieces[i] for i in part], width)):
                    out[i] = count
        return out

    def _together(self, pieces: list[bytes], width: int) -> list[int]:
        n, wide = len(pieces), width + 1
        raw, real = padded(pieces, width)
        symbol = np.full((n, wide), -1, np.int32)
        symbol[:, :width] = np.where(real, self.bytes[raw], -1)
        symbol = symbol.ravel()
        after = np.tile(np.minimum(np.arange(wide) + 1, width), n)
        before = np.tile(np.r_[width, np.arange(width)], n)
        # the rank of the pair that starts at a position now; what is popped with another rank is stale
        now = np.full((n, wide), NO_RANK, np.int32)
        now[:, : width - 1] = np.where(real[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], NO_RANK)
        # heaps stand in rows from column 1 on; a sorted row is a heap. Each merge takes a pair and may add two
        room = 4 * width
        heap = np.full((n, 2 * room), NO_RANK, np.int32)
        heap[:, 1 : width + 1] = np.sort(np.where(now[:, :width] < NO_RANK, now[:, :width] * width + np.arange(width), NO_RANK), axis=1)
        size = (now < NO_RANK).sum(1)
        now, heap = now.ravel(), heap.ravel()
        count = real.sum(1)

        def push(row: np.ndarray, key: np.ndarray) -> None:
            size[row] += 1
            node, base = size[row], row * (2 * room)
            heap[base + node] = key
            while True:
                above = heap[base + (node >> 1)]
                up = np.flatnonzero((node > 1) & (above > key))
                if not len(up):
                    return
                node, base, key = node[up], base[up], key[up]
                heap[base + node] = above[up]
                node = node >> 1
                heap[base + node] = key

        def pop(row: np.ndarray) -> np.ndarray:
            base = row * (2 * room)
            top, end = heap[base + 1], base + size[row]
            key = heap[end]
            heap[end] = NO_RANK
            size[row] -= 1
            filled = size[row] > 0
            base, key = base[filled], key[filled]
            heap[base + 1] = key
            node = np.ones(len(base), np.int64)
            while len(base):
                low, high = heap[base + 2 * node], heap[base + 2 * node + 1]
                least = np.minimum(low, high)
                down = np.flatnonzero(least < key)
                child = (2 * node + (high < low))[down]
                node, base, key, least = node[down], base[down], key[down], least[down]
                heap[base + node] = least
                heap[base + child] = key
                node = child
            return top

        row = np.flatnonzero(size)
        while len(row):
            top = pop(row)
            at, rank = top % width, top // width
            good = np.flatnonzero(now[row * wide + at] == rank)
            live, at, rank = row[good], at[good], rank[good]
            base = live * wide
            gone = after[base + at]
            right, left = after[base + gone], before[base + at]
            made = self.made[rank]
            symbol[base + at], symbol[base + gone], now[base + gone] = made, -1, NO_RANK
            after[base + at] = right
            before[base + right] = at
            count[live] -= 1
            rank = self.rank(made, symbol[base + right])
            now[base + at] = rank
            new = np.flatnonzero(rank < NO_RANK)
            push(live[new], rank[new] * width + at[new].astype(np.int32))
            some = np.flatnonzero(left < width)
            live, base, left, made = live[some], base[some], left[some], made[some]
            rank = self.rank(symbol[base + left], made)
            now[base + left] = rank
            new = np.flatnonzero(rank < NO_RANK)
            push(live[new], rank[new] * width + left[new].astype(np.int32))
            row = row[size[row] > 0]
        return count.tolist()

    def _parts(self, text: str, split: Callable[[str], list[str]]) -> tuple[list[str], int]:
        """Pieces of a text and the number of special tokens between them."""
        if self.special is None or not self.special.search(text):
            return split(self.prefix + text if self.prefix and text[:1] != " " else text), 0
        pieces: list[str] = []
        for part in self.special.split(text):
            if part:
                pieces += split(self.prefix + part if self.prefix and part[:1] != " " else part)
        return pieces, len(self.special.findall(text))

    def count(self, text_list: list[str]) -> list[int]:
        """Tokens of each text; a bounded number of characters is split at a time."""
        split, cache, out, start = splitter(), self.cache, [], 0
        while start < len(text_list):
            end, size = start, 0
            while end < len(text_list) and (end == start or size + len(text_list[end]) <= CHUNK_CHARS):
                size += len(text_list[end])
                end += 1
            parts = [self._parts(text, split) for text in text_list[start:end]]
            seen = set().union(*[row for row, _ in parts])
            if len(cache) + len(new := list(seen.difference(cache))) > CACHE_PIECES:
                cache.clear()
                new = list(seen)
            cache.update(zip(new, self.pieces([p.encode("utf-8") for p in new])))
            out += [special + sum([cache[p] for p in row]) for row, special in parts]
            start = end
        return out


_counters: dict[bytes, Counter] = {}


def counter(tokenizer_file: bytes) -> Counter:
    """The counter of a tokenizer file, built once in each worker; a file with options it doesn't know is refused."""
    key = hashlib.sha256(tokenizer_file).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(tokenizer_file)
    return _counters[key]


def count_tokens(df: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each whole text.

    Null counts as the empty text: 0 bytes, 0 tokens. Repeated rows give repeated results, other columns are
    ignored, an empty table gives an empty result, and very long texts are counted whole. The tokenizer file has
    a fixed size and is broadcast.
    """
    with open(tokenizer_path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def work(batch: pa.RecordBatch) -> dict:
        rows = [t or "" for t in texts(batch)]
        tokens = counter(shared.value).count(rows)
        return {"doc_id": column(batch, "doc_id"), "n_bytes": [len(t.encode("utf-8")) for t in rows], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_batches(id_and_text(df, id_col, text_col), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", work, lambda: counter(shared.value).cache.clear())
