"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every piece of a text holds one leaf per byte. A live leaf stores the rank of the pair that starts there, the
tree stores the leftmost minimum, and a merge updates the leaves of the live neighbours and their paths to the
root. Pieces of one batch that have about the same length share NumPy arrays, so each round merges the best
pair of every piece at once; long pieces have a tree of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, id_and_text, map_batches, texts
from .pairs import NO_RANK, PairTable, padded
from .pretokenize import BYTE_LEVEL_PATTERN, splitter

#: Pieces kept with their ids in a task before the memory is emptied; characters taken at a time.
CACHE_PIECES, CHUNK_CHARS = 300_000, 2_000_000
#: Longer pieces are merged one by one; so many share arrays, to stay in the processor's cache.
BATCH_BYTES = 64
BATCH_ROWS = 4_000


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file; vocabulary files have a fixed size, so they may be broadcast."""
    with open(path, "rb") as file:
        return file.read()


class Merger:
    """Token ids of pieces, by the ranks of a vocabulary whose ids are its ranks."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks.keys()))
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        keys = np.array(list(self.pairs), np.int64)
        self.rank = PairTable(keys >> 20, keys & 0xFFFFF, list(self.pairs.values()))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.first_pairs = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.cache: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > BATCH_BYTES:
                out[i] = np.array(self._long(piece), dtype="<u4").tobytes()
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            for start in range(0, len(rows), BATCH_ROWS):
                part = rows[start : start + BATCH_ROWS]
                for i, ids in zip(part, self._together([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _together(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n, wide = len(pieces), width + 1
        raw, real = padded(pieces, width)
        # a spare column takes what would fall off either end
        symbol = np.full((n, wide), -1, np.int32)
        symbol[:, :width] = np.where(real, self.first[raw], -1)
        after = np.tile(np.minimum(np.arange(wide) + 1, width), n)
        before = np.tile(np.r_[width, np.arange(width)], n)
        tree = np.full((n, 2 * width), NO_RANK, np.int32)
        rank = np.where(real[:, 1:], self.first_pairs[raw[:, :-1], raw[:, 1:]], NO_RANK)
        tree[:, width:-1] = np.where(rank < NO_RANK, rank * width + np.arange(width - 1), NO_RANK)
        for level in range(width.bit_length() - 2, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        symbol, tree = symbol.ravel(), tree.ravel()
        row = np.flatnonzero(tree[1 :: 2 * width] < NO_RANK)
        while len(row):
            base, root = row * wide, row * (2 * width)
            best = tree[root + 1]
            at, token = best % width, best // width
            gone = after[base + at]
            right, left = after[base + gone], before[base + at]
            symbol[base + at], symbol[base + gone] = token, -1
            after[base + at] = right
            before[base + right] = at
            leaf = root + width
            tree[leaf + gone] = NO_RANK
            with_right = self.rank(token, symbol[base + right])
            tree[leaf + at] = np.where(with_right < NO_RANK, with_right * width + at, NO_RANK)
            has_left = np.flatnonzero(left < width)
            with_left = self.rank(symbol[base[has_left] + left[has_left]], token[has_left])
            tree[leaf[has_left] + left[has_left]] = np.where(with_left < NO_RANK, with_left * width + left[has_left], NO_RANK)
            for start, node in ((root, gone), (root, at), (root[has_left], left[has_left])):
                node = (width + node) >> 1
                for _ in range(width.bit_length() - 1):
                    two = start + 2 * node
                    tree[start + node] = np.minimum(tree[two], tree[two + 1])
                    node = node >> 1
            row = row[tree[root + 1] < NO_RANK]
        symbol = symbol.reshape(n, wide)[:, :-1]
        live = symbol >= 0
        ids = symbol[live].astype("<u4").tobytes()
        start = 0
        for end in (np.cumsum(live.sum(1)) * 4).tolist():
            yield ids[start:end]
            start = end

    def _long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none, pairs = 1 << 60, self.pairs
        symbol: list[int] = [int(self.first[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            token, at = divmod(tree[1], width)
            gone = after[at]
            right, left = after[gone], before[at]
            symbol[at], symbol[gone], after[at] = token, -1, right
            put(gone, none)
            rank = None
            if right < n:
                before[right] = at
                rank = pairs.get(token << 20 | symbol[right])
            put(at, none if rank is None else rank * width + at)
            if left >= 0:
                rank = pairs.get(symbol[left] << 20 | token)
                put(left, none if rank is None else rank * width + left)
        return [s for s in symbol if s >= 0]

    def encode(self, text_list: list[str], pattern: str = BYTE_LEVEL_PATTERN) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; texts are taken a bounded number of characters at a time."""
        split, cache = splitter(pattern), self.cache
        start = 0
        while start < len(text_list):
            end, size = start, 0
            while end < len(text_list) and (end == start or size + len(text_list[end]) <= CHUNK_CHARS):
                size += len(text_list[end])
                end += 1
            pieces = [split(text) for text in text_list[start:end]]
            seen = set().union(*pieces)
            if len(cache) + len(new := list(seen.difference(cache))) > CACHE_PIECES:
                cache.clear()
                new = list(seen)
            cache.update(zip(new, self.encode_pieces([p.encode("utf-8") for p in new])))
            for row in pieces:
                yield b"".join([cache[p] for p in row])
            start = end

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


_mergers: dict[bytes, Merger] = {}


def merger(rank_file: bytes) -> Merger:
    """The merger of a rank file, built once in each worker."""
    key = hashlib.sha256(rank_file).digest()
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(rank_file)
    return _mergers[key]


def encode_documents(df: DataFrame, ranks_path: str, *, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again: ``(doc_id, ids binary, n_tokens, decoded binary)``.

    Null and empty texts have no ids and decode to nothing. Repeated rows give repeated results, other columns
    are ignored, and an empty table gives an empty result. Very long texts and pieces are merged whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work(batch: pa.RecordBatch) -> dict:
        encoder = merger(shared.value)
        ids = list(encoder.encode([t or "" for t in texts(batch)], pattern))
        return {"doc_id": column(batch, "doc_id"), "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [encoder.decode(x) for x in ids]}

    return map_batches(id_and_text(df, id_col, text_col), "doc_id bigint, ids binary, n_tokens bigint, decoded binary", work, lambda: merger(shared.value).cache.clear())


def encoding_digests(
    df: DataFrame, ranks_path: str, *, pattern: str = BYTE_LEVEL_PATTERN, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Digests of each whole text's ids and of the bytes they decode to: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    With ``keep_ids`` a column ``ids`` has the ids, little-endian unsigned 32-bit integers. Null and empty texts have no
    ids and the digests of the empty string. Repeated rows give repeated results, other columns are ignored, and an empty
    table gives an empty result. Very long texts and pieces are merged whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work(batch: pa.RecordBatch) -> dict:
        encoder = merger(shared.value)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for ids in encoder.encode([t or "" for t in texts(batch)], pattern):
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            out["ids"].append(ids if keep_ids else b"")
        return {"doc_id": column(batch, "doc_id"), **out}

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return map_batches(id_and_text(df, id_col, text_col), schema, work, lambda: merger(shared.value).cache.clear())
