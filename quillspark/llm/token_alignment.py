"""Alignment of two tokenizers' tokens by sparse products.

A text's tokens and bytes make an incidence matrix, one row for each token, in compressed sparse rows (``Csr``) built by hand.
With A of one tokenizer and B of the other, the product A . B' has an entry for each pair of tokens that share bytes, its
value how many: the overlap links.  Where tokens of both end, the bytes are cut into groups; products with the bytes' incidence
to groups say which group each token stands in, and the product of these two, which pairs of tokens share a group.  Products go
row by row (Gustavson): row i is the sum of the rows of the right matrix that its entries name, and blocks of rows are worked on
together.

Neither tokenizer joins what stands before a space with what stands after it, unless white space precedes the space.  So texts
are cut there into chunks, whose matrices are the blocks of a text's block-diagonal one; each distinct chunk is worked out once in
a Python worker, many at a time and those with signs at their end from their parts,, and a text's figures and groups are those of its chunks.

The texts are read once, and the pairs of ids of their links written.  These are counted over the corpus, and the counts looked
up.  Where the pairs are few enough (``MOST_PAIRS``, checked) tasks get them as one sorted array; beyond, each text's distinct
pairs are joined with the counts by a shuffle.  Both give the same rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import bound_batches, hold, materialize

#: Entries of a product that are made at once.
BLOCK = 4 << 20
#: Characters of chunks (with 64 more each) that one worker remembers, and chunks of a long text read at a time.
CACHE_CHARS, CHUNKS = 40 << 20, 500_000
#: Pairs of ids that are sent to all tasks: 17 bytes each, 71 MB.
MOST_PAIRS = 1 << 22
#: ASCII signs that may end a chunk; the apostrophe is not among them, as it begins contractions.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: What either tokenizer, in any version of Unicode, may take as white space, but for the space itself.
OTHER_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff"
OTHER = re.compile(f"[ {OTHER_SPACE}]")
CHUNK = re.compile(f"[ {OTHER_SPACE}]*[^ {OTHER_SPACE}]+(?:[{OTHER_SPACE}][ {OTHER_SPACE}]*[^ {OTHER_SPACE}]+)*(?:[{OTHER_SPACE}][ {OTHER_SPACE}]*)?|[ {OTHER_SPACE}]+")


# -- sparse matrices


@dataclass
class Csr:
    """Row i has the columns ``indices[indptr[i]:indptr[i + 1]]``, ascending, with values ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.r_[0, np.cumsum(counts)], self.rows()[order], self.data[order], len(self.indptr) - 1)


def incidence(lengths: np.ndarray) -> Csr:
    """Of tokens, one after another, to bytes."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends], np.arange(total), np.ones(total, np.int64), total)


def product_blocks(a: Csr, b: Csr) -> Iterator[Csr]:
    """Blocks of successive rows of ``a . b``: each row is the sum of the rows of ``b`` that the entries of ``a``'s row name."""
    wide = np.diff(b.indptr)[a.indices]
    made = np.r_[0, np.cumsum(wide)][a.indptr]  # entries before each row
    low, n = 0, len(a.indptr) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(made, made[low] + BLOCK, "right")) - 1)
        part = slice(a.indptr[low], a.indptr[high])
        widths, of = wide[part], a.indices[part]
        rows = np.repeat(np.repeat(np.arange(high - low), np.diff(a.indptr[low : high + 1])), widths)
        places = np.arange(len(rows)) + np.repeat(b.indptr[of] - np.r_[0, np.cumsum(widths)[:-1]] if len(of) else of, widths)
        keys = rows * b.columns + b.indices[places]
        values = np.repeat(a.data[part], widths) * b.data[places]
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(values, first) if len(first) else values
        row, column = np.divmod(keys[first], b.columns) if len(first) else (keys, keys)
        yield Csr(np.r_[0, np.cumsum(np.bincount(row, minlength=high - low))], column, sums, b.columns)
        low = high


def product(a: Csr, b: Csr) -> Csr:
    parts = list(product_blocks(a, b))
    if not parts:
        return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b.columns)
    before = np.cumsum([0, *(p.indptr[-1] for p in parts)])
    indptr = np.concatenate([[0], *(p.indptr[1:] + k for p, k in zip(parts, before))])
    return Csr(indptr, np.concatenate([p.indices for p in parts]), np.concatenate([p.data for p in parts]), b.columns)


def gathered(ptr: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the entries of ``rows``, in their order."""
    sizes = ptr[rows + 1] - ptr[rows]
    return np.arange(int(sizes.sum())) + np.repeat(ptr[rows] - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Aligned:
    """``links``: tokens of A by tokens of B, with their shared bytes; ``groups_a``, ``groups_b``: tokens by groups."""

    links: Csr
    groups_a: Csr
    groups_b: Csr

    def shared_groups(self) -> Iterator[Csr]:
        """Pairs of tokens in one group, in blocks of rows; a group of many tokens has all its pairs here."""
        return product_blocks(self.groups_a, self.groups_b.transposed())


def align(a: np.ndarray, b: np.ndarray) -> Aligned:
    """Of tokens of ``a`` and ``b`` bytes that cover the same bytes; none is empty."""
    one, other = incidence(a), incidence(b)
    cut = np.zeros(one.columns, bool)
    cut[np.intersect1d(one.indptr[1:], other.indptr[1:], assume_unique=True) - 1] = True
    group = np.cumsum(cut) - cut
    of_bytes = Csr(np.arange(one.columns + 1), group, np.ones(one.columns, np.int64), int(cut.sum()))
    return Aligned(product(one, other.transposed()), product(one, of_bytes), product(other, of_bytes))


# -- chunks


def loose(key: str) -> bool:
    """Whether a chunk may end with white space, so that the space after it belongs to it."""
    return not key or OTHER.match(key[-1]) is not None


def exact_chunks(text: str) -> Iterator[list[str]]:
    """A space and the text, cut before each space that follows no white space, in blocks; chunks without their first space."""
    found = CHUNK.finditer(" " + text)
    while block := [m[0][1:] for m in islice(found, CHUNKS)]:
        yield block


class Tokenizers:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in _byte_signs().items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, k in entries.items():
            self.a_bytes[k] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        sign, n = "▁", self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(sign, " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(sign)
        #: whether its tokens keep to chunks: none has a space after another sign
        self.splits = not any(sign in p.lstrip(sign) for p in pieces)

        #: signs that a token of the second may hold together with an ASCII sign after them
        self.before_signs = {x for p in pieces for x, y in zip(p, p[1:]) if y in SIGNS}

    def encode(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for a space, which the second puts there itself, and each key."""
        first = [x.ids for x in self.a.encode_batch_fast([" " + x for x in keys], add_special_tokens=False)]
        return first, [ids or [self.space] for ids in self.b.encode(keys, num_threads=1)]

    def encode_signs(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each run of signs after a letter."""
        first = [x.ids for x in self.a.encode_batch_fast(keys, add_special_tokens=False)]
        return first, [ids[1:] for ids in self.b.encode(["a" + x for x in keys], num_threads=1)]

    def stem(self, key: str) -> str:
        """The key without the signs at its end; whole where a token may join them with what stands before."""
        if key[-1:] not in SIGNS:
            return key
        stem = key.rstrip(SIGNS)
        last = stem[-1:]
        return stem if (last.isalpha() or last.isdecimal()) and last not in self.before_signs else key


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in byte-level entries: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Numbers(dict):
    """Numbers keys as they are met; ``new`` has those that are not learned yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = number = len(self)
        return number


class Aligner:
    """What a worker knows of the chunks it has met, by their numbers.  ``stats``: tokens of A and B, groups, links, pairs of
    tokens that share a group, whether the chunk's tokens do not give its bytes, whether the space after it may belong to it;
    ``keys[ptr[k]:ptr[k + 1]]``: the pairs of ids of its links; ``listed``: its groups."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.a_size = np.array(list(map(len, tokenizers.a_bytes)))
        self.b_size = np.array(list(map(len, tokenizers.b_bytes)))
        self.b_ids = len(self.b_size)
        self.clear()

    def clear(self) -> None:
        self.number, self.held = Numbers(), 0
        self.listed: list[str] = []
        self.stats = np.zeros((0, 7), np.int64)
        self.keys, self.ptr = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def full(self) -> bool:
        return self.held > CACHE_CHARS

    def _add(self, listed: list[str], stats: np.ndarray, keys: np.ndarray) -> None:
        self.listed += listed
        self.stats = np.concatenate([self.stats, stats])
        self.keys = np.concatenate([self.keys, keys])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(stats[:, 3])])

    def learn(self) -> None:
        """Learns the chunks that were numbered since: those without signs at their end first, the others from their parts."""
        number, stem = self.number, self.tokenizers.stem
        signs: dict[str, int] = {}
        while number.new:
            new, number.new = number.new, []
            self.held += sum(map(len, new)) + 64 * len(new)
            stems = list(map(stem, new))
            simple = [x for x, y in zip(new, stems) if x == y]
            made = [(number[x], y, signs.setdefault(x[len(y) :], len(signs))) for x, y in zip(new, stems) if x != y]
            # stems met here for the first time are numbered now and learned before what is made of them
            made = [(k, number[y], t) for k, y, t in made]
            while number.new:
                simple += number.new
                self.held += sum(map(len, number.new)) + 64 * len(number.new)
                number.new = []
            listed, stats, keys = [], [], []
            for low in range(0, len(simple), 20_000):
                some = simple[low : low + 20_000]
                parts = self._aligned([" " + x for x in some], *self.tokenizers.encode(some))
                parts[1][:, 6] = list(map(loose, some))
                for to, part in zip((listed, stats, keys), parts):
                    to.append(part)
            listed, stats, keys = sum(listed, []), np.concatenate(stats or [np.zeros((0, 7), np.int64)]), np.concatenate(keys or [np.zeros(0, np.int64)])
            if made:
                ends = list(signs)
                end_listed, end_stats, end_keys = self._aligned(ends, *self.tokenizers.encode_signs(ends))
                # all parts, as one table: what was known, what is new, runs of signs
                known = len(self.listed)
                at = {number[x]: known + k for k, x in enumerate(simple)}
                first = np.array([x if x < known else at[x] for _, x, _ in made])
                second = np.array([t for _, _, t in made]) + known + len(simple)
                every = np.concatenate([self.stats, stats, end_stats])
                every_keys = np.concatenate([self.keys, keys, end_keys])
                ptr = np.r_[0, np.cumsum(every[:, 3])]
                names = lambda k: self.listed[k] if k < known else listed[k - known] if k < known + len(listed) else end_listed[k - known - len(listed)]
                made_listed = [f"{names(x)};{names(y)}" for x, y in zip(first.tolist(), second.tolist())]
                made_stats = every[first] + every[second]
                made_keys = every_keys[gathered(ptr, np.stack([first, second], axis=1).ravel())]
            else:
                made_listed, made_stats, made_keys = [], stats[:0], keys[:0]
            # in the order of their numbers
            order = np.argsort(np.array([*(number[x] for x in simple), *(k for k, _, _ in made)], np.int64))
            listed, stats = listed + made_listed, np.concatenate([stats, made_stats])
            keys, ptr = np.concatenate([keys, made_keys]), np.r_[0, np.cumsum(stats[:, 3])]
            self._add([listed[k] for k in order.tolist()], stats[order], keys[gathered(ptr, order)])

    def _aligned(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``listed``, ``stats`` and ``keys`` of the texts, whose ids are ``a`` and ``b``."""
        t, n = self.tokenizers, len(texts)
        flat = lambda side, table: b"".join(map(table.__getitem__, chain.from_iterable(side)))
        bytes_of = [x.encode() for x in texts]
        sizes = lambda side, table: [sum(map(table.__getitem__, x)) for x in side]
        good = np.ones(n, bool)
        if not flat(a, t.a_bytes) == flat(b, t.b_bytes) == b"".join(bytes_of) or not sizes(a, self.a_size) == sizes(b, self.b_size) == list(map(len, bytes_of)):
            good = np.fromiter((flat([x], t.a_bytes) == flat([y], t.b_bytes) == s for s, x, y in zip(bytes_of, a, b)), bool, n)
            a, b = ([x if ok else [] for x, ok in zip(side, good)] for side in (a, b))
        na, nb = (np.fromiter(map(len, side), np.int64, n) for side in (a, b))
        a_ids, b_ids = (np.array(list(chain.from_iterable(side)), np.int64) for side in (a, b))
        of_a = np.repeat(np.arange(n), na)
        found = align(self.a_size[a_ids], self.b_size[b_ids])
        link_a, link_b = found.links.rows(), found.links.indices
        ga, gb = found.groups_a.indices, found.groups_b.indices  # each token stands in one group
        groups = found.groups_a.columns
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        chunk_of = np.zeros(groups, np.int64)
        chunk_of[ga] = of_a
        count = lambda of, w=None: np.bincount(of, weights=w, minlength=n).astype(np.int64)
        # the sum of a block of G_A . G_B' is that of its groups' products
        stats = np.stack([na, nb, count(chunk_of), count(of_a[link_a]), count(chunk_of, in_a * in_b), ~good, np.zeros(n, np.int64)], axis=1)
        ids = np.zeros(len(a_ids) + len(b_ids), np.int64)
        before_a, before_b = np.r_[0, np.cumsum(in_a)], np.r_[0, np.cumsum(in_b)]
        place_a, place_b = np.arange(len(a_ids)) + before_b[ga], np.arange(len(b_ids)) + before_a[gb + 1]
        ids[place_a], ids[place_b] = a_ids, b_ids
        ends = np.zeros(len(ids), np.int64)  # a comma after each id, but "|" after a group's last of A, ";" after its last of B
        ends[place_a[before_a[1:] - 1]], ends[place_b[before_b[1:] - 1]] = 1, 2
        text = [f"{k}{',|;'[e]}" for k, e in zip(ids.tolist(), ends.tolist())]
        to = np.cumsum(na + nb).tolist()
        return ["".join(text[x:y])[:-1] for x, y in zip([0, *to], to)], stats, a_ids[link_a] * self.b_ids + b_ids[link_b]

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def read(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs of a text's place and the numbers of its next chunks."""
        quick = [(k, self.numbers(text.split(" "))) for k, text in enumerate(texts) if text and len(text) < 8 * CHUNKS]
        self.learn()
        exact = {k for k, text in enumerate(texts) if text and len(text) >= 8 * CHUNKS}
        for k, numbers in quick:
            if self.stats[numbers, 6].any():  # a space after white space, or at an end
                exact.add(k)
            else:
                yield k, numbers
        for k in sorted(exact):
            for block in exact_chunks(texts[k]):
                numbers = self.numbers(block)
                self.learn()
                yield k, numbers

    def links(self, numbers: np.ndarray) -> np.ndarray:
        return self.keys[gathered(self.ptr, numbers)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner, made once in each Python worker."""
    hold(_aligners.clear)
    if (a_path, b_path) not in _aligners:
        made = Tokenizers(a_path, b_path)
        if not made.splits:
            raise ValueError("a token of the second tokenizer reaches over a space")
        _aligners[a_path, b_path] = Aligner(made)
    return _aligners[a_path, b_path]


# -- the corpus


def described(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, links`` of the rows; ``links`` has the pair of ids of
    each, as little-endian unsigned integers of eight bytes or, where they suffice, four."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        of_pair = pair_type(own.tokenizers)
        for batch in batches:
            if own.full():
                own.clear()
            n = batch.num_rows
            sums, hashes, links = np.zeros((n, 7), np.int64), [None] * n, [b""] * n
            for k, numbers in own.read(batch.column(1).to_pylist()):
                sums[k] += own.stats[numbers].sum(axis=0)
                listed = ";".join(map(own.listed.__getitem__, numbers.tolist())).encode()
                if hashes[k] is None:
                    hashes[k] = hashlib.sha256(listed)
                else:
                    hashes[k].update(b";" + listed)
                links[k] += own.links(numbers).astype(of_pair).tobytes()
            good = sums[:, 5] == 0
            sums[~good] = 0
            columns = [pa.array([uuid.uuid4().hex for _ in range(n)]), batch.column(0), *(pa.array(sums[:, c]) for c in range(5))]
            columns.append(pa.array([h.hexdigest() if h and ok else "" for h, ok in zip(hashes, good)], pa.string()))
            columns.append(pa.array([x if ok else b"" for x, ok in zip(links, good)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "links"])

    return docs.select("doc_id", "text").mapInArrow(run, f"row string, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, links binary")


def pair_type(tokenizers: Tokenizers) -> str:
    return "<u4" if len(tokenizers.a_bytes) * len(tokenizers.b_bytes) <= 1 << 32 else "<u8"


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def pair_counts(found: DataFrame, of_pair: str) -> DataFrame:
    """``key, n`` of every pair of ids that some link holds: the pair as one number, and how many links of the corpus hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, n = (np.concatenate(x) for x in zip(*held))
            keys, n = _counted(keys.astype(np.int64), n)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

        for batch in batches:
            links = np.concatenate([np.zeros(0, of_pair), *(np.frombuffer(x.as_buffer(), of_pair) for x in batch.column(0))])
            held.append(_counted(links))
            size += len(held[-1][0])
            if size > BLOCK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return found.select("links").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """Pairs, ascending, their counts, and whether that is the highest of their B id."""

    keys: np.ndarray
    n: np.ndarray
    best: np.ndarray


def looked_up(found: DataFrame, of_pair: str, sent: Broadcast) -> DataFrame:
    """``found`` with ``n_best, count_sum`` in place of ``links``, from the counts that all tasks have."""
    columns = [c for c in found.columns if c != "links"]
    schema = T.StructType([*(found.schema[c] for c in columns), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        keys = counts.keys.astype(of_pair)
        for batch in batches:
            best, sums = [], []
            for links in batch.column(len(columns)):
                at = np.searchsorted(keys, np.frombuffer(links.as_buffer(), of_pair))
                best.append(int(counts.best[at].sum()))
                sums.append(int(counts.n[at].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.int64()), pa.array(sums, pa.int64())], names=schema.fieldNames())

    return found.select(*columns, "links").mapInArrow(run, schema)


def joined(found: DataFrame, of_pair: str, counts: DataFrame) -> DataFrame:
    """As ``looked_up``, by a shuffle of each row's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column(0), batch.column(1)):
                keys, k = _counted(np.frombuffer(links.as_buffer(), of_pair))
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(k)], names=["row", "key", "k"])

    held = materialize(found.select("row", "links").mapInArrow(run, "row string, key long, k long"), "alignment-held").join(counts, "key")
    held = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = found.drop("links").join(held, "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared`` of every row; ``n_shared`` counts the
    pairs of tokens that share a group.

    A text that is null or empty, or whose tokens do not give its bytes, has no tokens: zeros and an empty digest; it counts
    nowhere else either.  Ids may be null or repeat; each row gives one row and counts as often as it occurs.  Very long texts
    are read whole, in blocks of chunks.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = Tokenizers(a_path, b_path)
    of_pair, b_ids = pair_type(both), len(both.b_bytes)
    found = materialize(described(rows, a_path, b_path), "alignment-rows", "zstd")
    pairs = materialize(pair_counts(found, of_pair), "alignment-pairs").withColumn("b", F.col("key") % b_ids)
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))  # no more rows than B has ids
    pairs = materialize(pairs.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-counts")
    if pairs.count() <= most_pairs:
        table = pairs.orderBy("key").toArrow()
        sent = spark.sparkContext.broadcast(Counts(*(table.column(c).to_numpy() for c in ("key", "n", "best"))))
        out = looked_up(found, of_pair, sent)
    else:
        out = joined(found, of_pair, pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
