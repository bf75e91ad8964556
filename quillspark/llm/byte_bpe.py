"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the byte positions keeps, for every node, the
leftmost pair of least rank below it (key = rank * size + position, so one minimum gives both); a merge reads the root and
updates the leaves of the merged pair, its live left neighbour and its dead right half, each in logarithmic time.

Short pieces, nearly all, are merged many at a time: the trees of equally sized pieces are the columns of one array and
every step works on all unfinished columns.  Long pieces use the same tree one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.shared import bound_batches, hold

NONE = np.iinfo(np.int64).max
#: Pieces up to this many bytes go to the arrays; longer ones to the single tree.
SHORT = 64
#: Pieces whose ids one Python worker remembers; a full memory is emptied.
CACHE = 600_000
#: Pieces of one text held at a time.
BLOCK = 200_000


class Vocabulary:
    """Merge ranks of a ``.tiktoken`` file, and every pair of tokens that joins into a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.by_text = {str(rank): token for rank, token in self.tokens.items()}
        self.split = regex.compile(pattern)
        self.single = np.zeros(256, np.int64)
        for byte in range(256):
            self.single[byte] = self.ranks[bytes([byte])]
        self.width = max(self.tokens) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, str] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair joins into no token."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    # -- one long piece -------------------------------------------------------------------------------------------

    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.single[np.frombuffer(piece, np.uint8)]
        keys = np.full(size, NONE, np.int64)
        ranks = self.rank(ids[:-1], ids[1:])
        found = ranks != NONE
        keys[: n - 1][found] = ranks[found] * size + np.flatnonzero(found)
        levels = [keys]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(axis=1))
        tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
        token, follow, before, pairs, width = ids.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)], self.pairs, self.width

        def put(at: int, key: int) -> None:
            node = at + size
            tree[node] = key
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while (key := tree[1]) != NONE:
            rank, at = divmod(key, size)
            dead = follow[at]
            after, prior = follow[dead], before[at]
            token[at], token[dead], follow[at] = rank, -1, after
            put(dead, NONE)
            new = pairs.get(rank * width + token[after]) if after < n else None
            put(at, NONE if new is None else new * size + at)
            if after < n:
                before[after] = at
            if prior >= 0:
                new = pairs.get(token[prior] * width + rank)
                put(prior, NONE if new is None else new * size + prior)
        return [x for x in token if x >= 0]

    # -- many short pieces ------------------------------------------------------------------------------------------

    def merge_short(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Merges pieces of 2 to ``size`` bytes; ``size`` is a power of two."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        padded = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(count, size).T
        place = np.arange(size, dtype=np.int64)[:, None]
        token = np.where(place < lengths, self.single[padded], -1)
        follow = np.repeat(place + 1, count, axis=1)
        before = np.repeat(place - 1, count, axis=1)
        tree = np.full((2 * size, count), NONE, np.int64)
        ranks = self.rank(token[:-1], token[1:])
        ranks[place[1:] >= lengths] = NONE
        tree[size : 2 * size - 1] = np.where(ranks == NONE, NONE, ranks * size + place[:-1])
        low = size
        while low > 1:
            tree[low // 2 : low] = np.minimum(tree[low : 2 * low : 2], tree[low + 1 : 2 * low : 2])
            low //= 2

        def put(at: np.ndarray, cols: np.ndarray, keys: np.ndarray) -> None:
            node = at + size
            tree[node, cols] = keys
            while node[0] > 1:
                node = node >> 1
                tree[node, cols] = np.minimum(tree[2 * node, cols], tree[2 * node + 1, cols])

        live = np.flatnonzero(tree[1] != NONE)
        while len(live):
            rank, at = np.divmod(tree[1, live], size)
            dead = follow[at, live]
            after, prior = follow[dead, live], before[at, live]
            token[at, live], token[dead, live], follow[at, live] = rank, -1, after
            put(dead, live, np.full(len(live), NONE))
            new = self._next_keys(rank, token[np.minimum(after, size - 1), live], after < lengths[live], at, size)
            put(at, live, new)
            here = after < lengths[live]
            before[after[here], live[here]] = at[here]
            here = prior >= 0
            cols = live[here]
            if len(cols):
                put(prior[here], cols, self._next_keys(token[prior[here], cols], rank[here], True, prior[here], size))
            live = live[tree[1, live] != NONE]
        kept = token.T >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = token.T[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _next_keys(self, left: np.ndarray, right: np.ndarray, valid, at: np.ndarray, size: int) -> np.ndarray:
        ranks = np.where(valid, self.rank(left, right), NONE)
        return np.where(ranks == NONE, NONE, np.where(ranks == NONE, 0, ranks) * size + at)

    # -- pieces and texts -------------------------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) <= SHORT:
                by_size.setdefault(8 if len(piece) <= 8 else 16 if len(piece) <= 16 else SHORT, []).append(k)
            else:
                out[k] = self.merge_long(piece)
        for size, places in by_size.items():
            for start in range(0, len(places), 65_536):
                some = places[start : start + 65_536]
                for k, ids in zip(some, self.merge_short([pieces[k] for k in some], size)):
                    out[k] = ids
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remembers the ids, as decimal text, of pieces not yet known."""
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(pieces)
        for piece, ids in zip(new, self.merge([x.encode() for x in new])):
            self.known[piece] = ",".join(map(str, ids)) if len(ids) > 1 else str(ids[0])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """Pairs of a text's place and the ids, joined by commas, of its next block; new pieces are learned together."""
        group: list[tuple[int, list[str]]] = []
        held = 0
        for k, text in enumerate(texts):
            if len(text) > 4 * BLOCK:
                matches = self.split.finditer(text)
                while block := [m[0] for m in islice(matches, BLOCK)]:
                    self.learn(set(block))
                    yield k, ",".join(map(self.known.__getitem__, block))
            elif text:
                group.append((k, self.split.findall(text)))
                held += len(group[-1][1])
            if group and (k + 1 == len(texts) or held > 5 * BLOCK):
                self.learn(set(chain.from_iterable(x for _, x in group)))
                for at, pieces in group:
                    yield at, ",".join(map(self.known.__getitem__, pieces))
                group, held = [], 0

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(","))) if ids else b""


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary, loaded once in each Python worker."""
    hold(_loaded.clear)
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def round_trip(vocab: Vocabulary, texts: list[str], keep_ids: bool = False) -> list[tuple[int, str, str, list[int] | None]]:
    """Count, digest of the ids, digest of the bytes decoded from them and, if asked for, the ids of each text."""
    rows = [[0, hashlib.sha256(), hashlib.sha256(), [] if keep_ids else None] for _ in texts]
    for k, ids in vocab.encode(texts):
        if ids:
            row = rows[k]
            row[1].update(b"," * (row[0] > 0) + ids.encode())
            row[2].update(vocab.decode(ids))
            row[0] += ids.count(",") + 1
            if keep_ids:
                row[3].extend(map(int, ids.split(",")))
    return [(n, encoded.hexdigest(), decoded.hexdigest(), ids) for n, encoded, decoded, ids in rows]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the id column, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``, ``token_ids``.  A null
    text counts as empty: no tokens and the digests of nothing.  Ids may be null or repeat; each row gives one row.  Other
    columns, whatever their names, are not read.  ``path`` must be readable where the tasks run.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # some texts with their ids at a time
                part = batch.slice(start, 256)
                rows = round_trip(vocab, [text or "" for text in part.column(1).to_pylist()], keep_ids)
                counts, encoded, decoded, ids = zip(*rows)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
