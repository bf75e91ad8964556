"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is the stream of its lower-cased words and one end.  Words are numbered by how often they occur in training, and a
word's number is told by binary choices: its length in bits by a Huffman code, then those bits, the first one, always 1, left
out.  Numbers of one length go in the order of spelling, so that choices are shared by words that look alike.  Words beyond the
``HEAD`` most frequent ones, those met ``RARE`` times at most, and unknown ones, share a number; what such a word is worth within it
comes by a join with all words' counts: its part of the rare words' occurrences if training has it, else its spelling, a Huffman
code for each byte and for a space at the end.

Each choice is predicted from its share in all training words, and in four contexts.  For numbers: the last one of the 63 most
frequent words in the text; the word before; the two words before; the second word before.  For spelling: the last one, three,
four and six bytes of the word.  A context and the choices made before are hashed to a slot of that context's table, whose counts
of zeros and ones give a probability.  Logits are added up with weights that a gate picks, by how well three of the contexts are
known; a last table refines the outcome.  Minus the sum of the logarithms is the text's total bits.  ``DEPTH`` successive choices of
a word have slots next to each other, in an order that the hash picks, so that they are read together.

Each task reads its part of the training texts once, in batches; it predicts every batch from what it has counted before, moves
weights and refining table by the gradient, and counts the batch.  Spelling is learned from the distinct rare words.  Blocks of
slots are summed by a shuffle, and weights are averaged by use.
The tables grow with the number of training words up to ``MOST_BITS``, so that every task can hold them; beyond, contexts share
slots.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, held_out, hold, materialize

#: Contexts of a choice, and inputs of the mixer: those and the choice's share in all training words.
CONTEXTS, INPUTS = 4, 5
#: Words with numbers of their own.
HEAD = (1 << 18) - 1
#: Words met so often at most have none.
RARE = 2
#: Stands for rare and unknown words; no word is a space.
SPELLED = b" "
#: The last bytes that each spelling context holds; of all contexts the first three pick the gate.
ORDERS = (3, 4, 6, 1)
#: Numbers under this make the first context.
FREQUENT = 64
#: Slots of each table as powers of two: numbers' contexts, then those of spelling; less where training is smaller.
MOST_BITS = (22, 22, 22, 22, 20, 21, 22, 16)
LEAST_BITS = 16
#: Slots that are added up together.
BLOCK = 1 << 16
#: Successive choices of a word that share a line of slots, and the bits of a choice's place in it.
DEPTH = 3
LINE = np.uint64((1 << DEPTH) - 1)
#: A context's counts, in steps; each twice, for contexts in which a choice was always the same.
LEVELS = 16
GATES, REFINED = 2 * LEVELS * LEVELS * 3, 33
#: Words of one step while learning, and while scoring; bytes of one step of spelling.
LEARN_WORDS, SCORE_WORDS, LETTERS = 6000, 3000, 16_000
WEIGHT_RATE, REFINE_RATE = 0.03, 0.05
#: Words whose choices are laid out at once.
PIECE = 1 << 12
#: Words held at once while counting.
HELD = 400_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ``take`` is asked to clip below, as it is faster so; no place is out of range


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# ---- choices ------------------------------------------------------------------------------------------------------------


def in_order(words: list[bytes], counts: np.ndarray, tail: int) -> tuple[list[bytes], np.ndarray]:
    """The numbered words, the one with number 1 first, and the number of each of ``words``.

    ``words`` go by falling count; ``tail`` is the number of spelled ones.
    """
    at = int(np.searchsorted(-counts, -tail))
    ranked = [*words[:at], SPELLED, *words[at:]]
    out: list[bytes] = []
    while len(out) < len(ranked):
        out += sorted(ranked[len(out) : 2 * len(out) + 1])
    number = {word: k + 1 for k, word in enumerate(out)}
    return out, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of choices of each symbol, and all symbols' nodes (from 0) and choices, one symbol after another."""
    heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(len(heap), 2 * len(heap) - 1):
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        parent[one[2]], parent[two[2]] = (node, 0), (node, 1)
        heapq.heappush(heap, (one[0] + two[0], node, node))
    sizes, nodes, bits = [], [], []
    for symbol in range(len(counts)):
        path, at = [], symbol
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        sizes.append(len(path))
        nodes += [node - len(counts) for node, _ in reversed(path)]
        bits += [bit for _, bit in reversed(path)]
    return np.array(sizes, np.int64), np.array(nodes, np.int32), np.array(bits, np.int8)


def expanded(symbols: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol's choices: its place in ``symbols`` and that of the choice among all symbols'; and the sizes."""
    own = sizes[symbols]
    total = np.cumsum(own)
    of = np.repeat(np.arange(len(symbols)), own)
    return of, np.arange(len(of)) + (starts[symbols] - (total - own))[of], own


def lines(nodes: np.ndarray, bits: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For choices of words, one word after another, ``step`` being a choice's number in its word: a hash of the node at which
    the choice's line begins, and in the lowest bits its place there, told by the choices since."""
    deep = step % DEPTH
    place = np.ones(len(nodes), np.uint64)
    for back in range(DEPTH - 1, 0, -1):
        at = np.flatnonzero(deep >= back)
        place[at] = 2 * place[at] + bits[at - back].astype(np.uint64)
    return _mix(nodes[np.arange(len(nodes)) - deep].astype(np.uint64) * _A) & ~LINE | place


class Shares:
    """The share of ones among all choices at each node."""

    def __init__(self, nodes: int):
        self.counts = np.zeros((2, nodes))

    def add(self, nodes: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> None:
        for bit in (0, 1):
            self.counts[bit] += np.bincount(nodes, weights=counts * (bits == bit), minlength=self.counts.shape[1])

    def logits(self) -> np.ndarray:
        return _logit(*self.counts).astype(np.float32)


class Codes:
    """Nodes, choices and their shares, of numbers and of letters."""

    def __init__(self, words: list[bytes] | pa.Array, counts: np.ndarray):
        self.words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        self.spelled = pc.index(self.words, SPELLED).as_py() + 1
        x = np.arange(len(words) + 1, dtype=np.int64)
        x[0] = 1
        length = np.floor(np.log2(x)).astype(np.int64)
        sizes, nodes, bits = huffman(np.bincount(length[1:], weights=counts))
        weights = np.r_[0, counts]
        starts, lengths = np.cumsum(sizes) - sizes, len(sizes)
        self.sizes = sizes[length] + length
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: of every word's choices the node, doubled, and the choice; of every node its line and share
        self.choices, share = np.empty(int(self.sizes.sum()), np.int32), Shares(lengths + 2 * len(x))
        self.line_of = np.empty(lengths + 2 * len(x), np.uint64)
        for piece in (slice(k, k + PIECE) for k in range(0, len(x), PIECE)):  # as all choices at once take much memory
            place = slice(self.starts[piece][0], self.starts[piece][-1] + self.sizes[piece][-1])
            of = np.repeat(np.arange(len(x))[piece], self.sizes[piece])
            own, step = length[of], np.arange(len(of)) + place.start - self.starts[of]
            late = step - sizes[own]
            left = np.maximum(own - np.maximum(late, 0), 1)
            flat = np.minimum(starts[own] + step, len(nodes) - 1)
            node = np.where(late < 0, nodes[flat], lengths + (1 << own) + (x[of] >> left))
            bit = np.where(late < 0, bits[flat], (x[of] >> (left - 1)) & 1)
            self.choices[place] = 2 * node + bit
            self.line_of[node] = lines(node, bit, step)
            share.add(node, bit, weights[of])
        self.share_of = share.logits()
        met = np.bincount(np.frombuffer(b" ".join(self.words.to_pylist()), np.uint8), minlength=256)
        self.letter_sizes, nodes, self.letter_bits = huffman(met)
        self.letter_starts = np.cumsum(self.letter_sizes) - self.letter_sizes
        self.letter_lines = lines(nodes, self.letter_bits, np.arange(len(nodes)) - np.repeat(self.letter_starts, self.letter_sizes))
        share = Shares(256)
        share.add(nodes, self.letter_bits, np.repeat(met, self.letter_sizes))
        self.letter_shares = share.logits()[nodes]

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {word: k + 1 for k, word in enumerate(self.words.to_pylist())}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of ``words``, many at a time, as Arrow hashes all numbered words anew."""
        return pc.fill_null(pc.index_in(words, self.words), self.spelled - 1).to_numpy().astype(np.int64) + 1

    @property
    def bits(self) -> np.ndarray:
        """All words' choices."""
        return (self.choices & 1).astype(np.int8)

    @property
    def shares(self) -> np.ndarray:
        """The shares at all words' choices."""
        return self.share_of[self.choices >> 1]


@dataclass
class Tables:
    """Where each context's table lies among the slots."""

    bits: tuple[int, ...]

    def __post_init__(self) -> None:
        self.offsets = np.cumsum([0, *(1 << b for b in self.bits)])
        self.slots = int(self.offsets[-1])

    def at(self, table: int, context: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Slots of (context, line, place); the line's multiple is mixed in once more so that neighbours in a tree part."""
        found = context ^ line
        found *= _B
        found >>= np.uint64(64 - self.bits[table])
        found ^= place
        found = found.view(np.int64)
        found += self.offsets[table]
        return found


def tables_for(words: int) -> Tables:
    """The more training words, the larger the tables, within the bounds."""
    grown = max(LEAST_BITS, math.ceil(math.log2(words + 1)) - 2)
    return Tables(tuple(min(b, grown) for b in MOST_BITS))


def number_choices(codes: Codes, tables: Tables, ids: np.ndarray, first: np.ndarray, lead: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each context and choice, the choices' shares, the choices, and each word's number of choices, without the ``lead`` first words.

    ``ids``: numbers of a stream of texts' words; ``first``: whether a text begins there.
    """
    place = np.arange(len(ids))
    begin = np.maximum.accumulate(np.where(first, place, 0))
    before = np.r_[0, ids[:-1]]
    before[place == begin] = 0
    second = np.r_[0, before[:-1]]
    second[place == begin] = 0
    seen = np.maximum.accumulate(np.where(ids < FREQUENT, place, -1))
    seen = np.r_[-1, seen[:-1]]
    last = np.where(seen >= begin, ids[seen], 0)
    before, second, last = (x[lead:].astype(np.uint64) for x in (before, second, last))
    contexts = [_mix(last * _A + np.uint64(1)), _mix(before * _A + np.uint64(2)), _mix(_mix(before * _A + np.uint64(3)) + second), _mix(second * _A + np.uint64(4))]
    of, flat, sizes = expanded(ids[lead:], codes.sizes, codes.starts)
    nodes = codes.choices.take(flat, mode="clip")
    bits = (nodes & 1).astype(np.int8)
    nodes >>= 1
    line = codes.line_of.take(nodes, mode="clip")
    place = line & LINE
    line ^= place
    slots = [tables.at(t, context.take(of, mode="clip"), line, place) for t, context in enumerate(contexts)]
    return slots, codes.share_of.take(nodes, mode="clip"), bits, sizes


def letter_choices(codes: Codes, tables: Tables, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The same for the spelling of ``words``, each on its own."""
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(joined)) - np.repeat(starts, lengths)
    of, flat, sizes = expanded(joined, codes.letter_sizes, codes.letter_starts)
    bits, line = codes.letter_bits.take(flat, mode="clip"), codes.letter_lines.take(flat, mode="clip")
    within = line & LINE
    line ^= within
    last, by_order, plus = np.zeros(len(joined), np.uint64), {}, joined + np.uint64(1)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.r_[np.zeros(min(order, len(joined)), np.uint64), plus[: max(0, len(joined) - order)]]
        last = last * np.uint64(0x100000001B3) + np.where(place >= order, shifted, np.uint64(0))
        by_order[order] = _mix(last + np.uint64(order << 56))
    slots = [tables.at(CONTEXTS + t, by_order[order].take(of, mode="clip"), line, within) for t, order in enumerate(ORDERS)]
    return slots, codes.letter_shares.take(flat, mode="clip"), bits, np.add.reduceat(sizes, starts)


# ---- the mixer ----------------------------------------------------------------------------------------------------------


def _logit(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))


def _level(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Length in bits of the count, up to seven, doubled, and one more if both choices were met."""
    length = np.clip(((zeros + ones).view(np.int32) >> 23) - 126, 0, 7)  # of a float the exponent
    length <<= 1
    length += (zeros > 0) & (ones > 0)
    return length


#: The level of two counts, each up to 64, as 64 in all give the greatest length.
_LEVELS = _level(*(np.arange(1 << 14) // np.array([[1], [128]]) % 128).astype(np.float32)).astype(np.int8)


def _level_of(pair: np.ndarray) -> np.ndarray:
    """``_level`` of each slot's zeros and ones, which follow one another."""
    least = np.minimum(pair, 64)
    at = least[1::2] << 7
    at += least[::2]
    return _LEVELS.take(at, mode="clip")


def _gates(kind: int, levels: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    one, two, three = levels
    return ((kind * LEVELS + one.astype(np.int64)) * LEVELS + two) * 3 + np.minimum(three >> 1, 2)


def _mixed(inputs: list[np.ndarray], gates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = weights[INPUTS].take(gates, mode="clip")
    for t in range(INPUTS):
        out += weights[t].take(gates, mode="clip") * inputs[t]
    return np.clip(out, -11.99, 11.99, out=out)


def _refine(mixed: np.ndarray, gates: np.ndarray, refined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The refined logit, and the cell and share it comes from: halfway between the mixed logit and the table's."""
    at = (mixed + np.float32(12)) * np.float32((REFINED - 1) / 24)
    low = at.astype(np.int64)
    part = at - low.astype(np.float32)
    cell = gates * REFINED + low
    return (mixed + refined.take(cell, mode="clip") * (1 - part) + refined.take(cell + 1, mode="clip") * part) / 2, cell, part


def start() -> tuple[np.ndarray, np.ndarray]:
    """All contexts alike; a table that changes nothing."""
    weights = np.full((INPUTS + 1, GATES), 0.3, np.float32)
    weights[INPUTS] = 0
    return weights, np.tile(np.linspace(-12, 12, REFINED, dtype=np.float32), GATES)


class Learner:
    """Online steps on counts, weights and refining table; each entry's pace falls with the gradients it has met."""

    def __init__(self, tables: Tables):
        self.counts = np.zeros(2 * tables.slots, np.int32)  # a slot's zeros, then its ones
        self.weights, self.refined = start()
        self.used = np.zeros(GATES)
        self.weight_pace, self.refine_pace = np.full(self.weights.shape, 1e-4, np.float32), np.full(self.refined.shape, 1e-4, np.float32)

    def step(self, kind: int, slots: list[np.ndarray], shares: np.ndarray, bits: np.ndarray) -> None:
        """Predicts the choices from what was counted before, learns from them, and counts them."""
        both = self.counts.view(np.int64)
        one = np.left_shift(1, 32 * bits.astype(np.int64))  # to a slot's zeros or its ones
        inputs, levels = [], []
        for t, slot in enumerate(slots):
            before = both.take(slot, mode="clip")
            np.add.at(both, slot, one)  # at once, while the table's lines are near
            pair = before.view(np.int32)
            if t < 3:
                levels.append(_level_of(pair))
            pair = pair.astype(np.float32)
            pair += np.float32(0.3)  # the logit, by two logarithms of all at once
            np.log(pair, out=pair)
            inputs.append(pair[1::2] - pair[::2])
        inputs.append(shares)
        gates = _gates(kind, tuple(levels))
        mass = np.bincount(gates, minlength=GATES)
        met = np.flatnonzero(mass)
        per = 1 / mass[met].astype(np.float32)
        mixed = _mixed(inputs, gates, self.weights)
        error = bits - 1 / (1 + np.exp(-mixed))
        for t in range(INPUTS + 1):
            slope = np.bincount(gates, weights=error * inputs[t] if t < INPUTS else error, minlength=GATES)[met].astype(np.float32) * per
            self.weight_pace[t, met] += slope**2
            self.weights[t, met] += WEIGHT_RATE * slope / np.sqrt(self.weight_pace[t, met])
        final, cell, part = _refine(mixed, gates, self.refined)
        error = bits - 1 / (1 + np.exp(-final))
        late = error * part
        slope = np.bincount(cell, weights=error - late, minlength=GATES * REFINED)
        slope[1:] += np.bincount(cell, weights=late, minlength=GATES * REFINED)[:-1]
        slope = slope.reshape(GATES, REFINED)[met].astype(np.float32) * per[:, None]
        pace, refined = self.refine_pace.reshape(GATES, REFINED), self.refined.reshape(GATES, REFINED)
        pace[met] += slope**2
        refined[met] += REFINE_RATE * slope / np.sqrt(pace[met])
        self.used += mass


#: Counts by code, exact up to ten and within a twentieth beyond.
VALUES = np.rint(2 ** (np.arange(256) / 8) - 1).astype(np.float32)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """A byte for each count, on a logarithmic scale; the greatest code stands for all counts beyond it."""
    return np.minimum(np.rint(8 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)


class Model:
    """A code of the counts of zeros and ones by slot; gated weights; the refining table."""

    def __init__(self, levels: np.ndarray, weights: np.ndarray, refined: np.ndarray):
        self.levels, self.weights, self.refined = levels, weights, refined
        code = np.arange(1 << 16)
        zeros, ones = VALUES[code & 255], VALUES[code >> 8]
        self.logit, self.level = _logit(zeros, ones), _level(zeros, ones).astype(np.int8)

    def logs(self, kind: int, slots: list[np.ndarray], shares: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word's choices."""
        if not len(sizes):
            return np.empty(0)
        codes = [self.levels.take(slot, mode="clip").astype(np.intp) for slot in slots]
        gates = _gates(kind, tuple(self.level.take(codes[t], mode="clip") for t in range(3)))
        final, _, _ = _refine(_mixed([*(self.logit.take(c, mode="clip") for c in codes), shares], gates, self.weights), gates, self.refined)
        logs = np.log(1 + np.exp(final * (1 - 2 * bits)))
        upto = np.cumsum(logs, dtype=np.float64)[np.cumsum(sizes) - 1]
        return -np.diff(upto, prepend=0) / math.log(10)


# ---- streams ------------------------------------------------------------------------------------------------------------


@dataclass
class Part:
    """Part of a stream of texts: words' numbers, whether a text begins, how many words only lead, the spelled words and
    the texts that they and all words are of."""

    ids: np.ndarray
    first: np.ndarray
    lead: int
    spelled: list[bytes]
    text_of: np.ndarray


@dataclass
class Numbered:
    """Texts one after another: their words' numbers, where each text starts and the last one ends, and the words without numbers,
    if they are asked for."""

    ids: np.ndarray
    starts: np.ndarray
    spelled: pa.Array | None


def numbered(words: pa.Array, starts: np.ndarray, codes: Codes, spelled: bool = True) -> Numbered:
    ids = codes.numbers(words)
    return Numbered(ids, starts, words.take(pa.array(np.flatnonzero(ids == codes.spelled))) if spelled else None)


def numbered_lists(texts: list[list[bytes]], codes: Codes) -> Numbered:
    return numbered(pa.array(chain.from_iterable(texts), pa.large_binary()), np.cumsum([0, *map(len, texts)]), codes)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, each text's followed by its end, and where each text starts and the last one ends: ``tokens`` of many."""
    own = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # as Arrow lower-cases slices wrongly
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(own))
    filled = np.flatnonzero(pc.binary_length(lower).to_numpy())  # what is empty has no word
    found = pc.ascii_split_whitespace(lower.take(pa.array(filled)))
    sizes = np.ones(len(lower), np.int64)
    sizes[filled] += pc.list_value_length(found).to_numpy()
    starts = np.cumsum(np.r_[0, sizes])
    words, inner = found.flatten().cast(pa.large_binary()), np.ones(starts[-1], bool)
    inner[starts[1:] - 1] = False
    place = np.where(inner, np.cumsum(inner) - 1, len(words))
    return pa.concat_arrays([words, pa.array([b""], pa.large_binary())]).take(pa.array(place)), starts


def parts(texts: Iterable[list[bytes]] | Iterable[Numbered], codes: Codes, size: int) -> Iterator[Part]:
    """A stream of texts in parts of about ``size`` words; a text longer than that is cut.

    Words lead that stand before the part in the same text: the last frequent one and the last two.
    """
    pieces: list[np.ndarray] = []
    spelled: list[bytes] = []
    lengths: list[int] = []
    numbers: list[int] = []
    led = np.empty(0, np.int64)

    def out() -> Part:
        ids = np.concatenate([led, *pieces])
        starts = len(led) + np.cumsum([0, *lengths[:-1]])
        first = np.zeros(len(ids), bool)
        first[starts] = True
        if len(led):
            first[starts[0]], first[0] = False, True
        return Part(ids, first, len(led), spelled, np.repeat(numbers, lengths))

    number, held = -1, 0
    for some in texts:
        some = some if isinstance(some, Numbered) else numbered_lists([some], codes)
        others, at = np.empty(0, np.int64) if some.spelled is None else np.flatnonzero(some.ids == codes.spelled), 0
        for low, high in zip(some.starts[:-1].tolist(), some.starts[1:].tolist()):
            number += 1
            for k in range(low, high, size):
                piece = some.ids[k : min(k + size, high)]
                until = int(np.searchsorted(others, k + len(piece)))
                spelled += some.spelled.slice(at, until - at).to_pylist() if until > at else []
                at = until
                pieces.append(piece)
                lengths.append(len(piece))
                numbers.append(number)
                held += len(piece)
                if held >= size:
                    yield (part := out())
                    pieces, spelled, lengths, numbers, held = [], [], [], [], 0
                    if k + size < high:
                        here = part.ids[np.flatnonzero(part.first)[-1] :]
                        frequent = np.flatnonzero(here < FREQUENT)
                        led = np.r_[here[frequent[-1]] if len(frequent) else here[:1], here[-2:]]
                    else:
                        led = np.empty(0, np.int64)
    if pieces:
        yield out()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over all rows; the end is the empty word.  Tasks add up what they hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                held[b""] += 1
                if len(held) > HELD:
                    yield from out()
        yield from out()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Parts of the input that one learning task reads; each task puts out a table of its counts.
PARTS_OF_TASK = 4


def learning_tasks(texts: DataFrame) -> int:
    return max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(texts.rdd.getNumPartitions() / PARTS_OF_TASK))


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The low bytes of all counts, and place and rest of those that need more."""
    more = np.flatnonzero(counts > 255).astype(np.int32)
    return zlib.compress(counts.astype(np.uint8).tobytes(), 1), np.stack([more, counts[more] >> 8]).tobytes()


def unpacked(low: bytes, more: bytes) -> np.ndarray:
    counts = np.frombuffer(zlib.decompress(low), np.uint8).astype(np.int64)
    places, rest = np.frombuffer(more, np.int32).reshape(2, -1)
    counts[places] += rest.astype(np.int64) << 8
    return counts


def learned_parts(texts: DataFrame, rare: DataFrame, words: Broadcast, tables: Tables) -> DataFrame:
    """``block, counts, more`` of every task: its packed counts by block of slots; in block -1 weights and refining table, and use."""

    def of_numbers(codes: Codes, learner: Learner, batches: Iterator[pa.RecordBatch]) -> None:
        stream = (numbered(*split(batch.column(0)), codes, spelled=False) for batch in batches)
        for part in parts(stream, codes, LEARN_WORDS):
            learner.step(0, *number_choices(codes, tables, part.ids, part.first, part.lead)[:-1])

    def of_letters(codes: Codes, learner: Learner, batches: Iterator[pa.RecordBatch]) -> None:
        for some in by_bytes((word for batch in batches for word in batch.column(0).to_pylist()), LETTERS):
            learner.step(1, *letter_choices(codes, tables, some)[:-1])

    def run(learn: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, learner = Codes(*words.value), Learner(tables)
        learn(codes, learner, batches)
        counts = learner.counts.reshape(-1, 2 * BLOCK)
        for block, own in enumerate(counts):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([part], pa.binary()) for part in packed(own))], names=["block", "counts", "more"])
        both = np.r_[learner.weights.ravel(), learner.refined].astype(np.float64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([both], pa.binary()), pa.array([learner.used.tobytes()], pa.binary())], names=["block", "counts", "more"])

    schema = "block int, counts binary, more binary"
    return texts.mapInArrow(partial(run, of_numbers), schema).unionByName(rare.mapInArrow(partial(run, of_letters), schema))


def by_bytes(words: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    batch, held = [], 0
    for word in words:
        batch.append(word)
        held += len(word) + 1
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _shares(used: np.ndarray) -> np.ndarray:
    """How much each weight and each entry of the refining table was used."""
    return np.r_[np.tile(used, INPUTS + 1), np.repeat(used, REFINED)]


def fit(texts: DataFrame, rare: DataFrame, words: Broadcast, tables: Tables) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Learned from ``texts`` and the words ``rare``: codes of all slots, packed, of a bounded size; weights and refining table averaged over the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, own, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if block < 0:
                    share = _shares(np.frombuffer(more.as_buffer()))
                    counts = np.r_[np.frombuffer(own.as_buffer()) * share, share]
                else:
                    counts = unpacked(own.as_py(), more.as_py())
                sums[block] = sums[block] + counts if block in sums else counts
        for block, counts in sums.items():
            codes = counts.tobytes() if block < 0 else zlib.compress(codes_of(counts).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([codes], pa.binary())], names=["block", "codes"])

    spread = learned_parts(texts, rare, words, tables).repartition(texts.sparkSession.sparkContext.defaultParallelism, "block")
    found = spread.mapInArrow(add, "block int, codes binary").toArrow()
    codes = np.zeros(2 * tables.slots, np.uint8)
    weights, refined = start()
    for block, part in zip(found.column("block").to_pylist(), found.column("codes")):
        if block < 0:
            total, share = np.frombuffer(part.as_py()).reshape(2, -1)
            mean = np.where(share > 0, total / np.maximum(share, 1), np.r_[weights.ravel(), refined])
            weights, refined = mean[: weights.size].reshape(weights.shape).astype(np.float32), mean[weights.size :].astype(np.float32)
        else:
            codes[block * 2 * BLOCK : (block + 1) * 2 * BLOCK] = np.frombuffer(zlib.decompress(part.as_py()), np.uint8)
    return zlib.compress(codes.tobytes(), 1), weights, refined


_ready: dict[str, tuple[Codes, Model]] = {}


def ready(key: str, words: Broadcast, learned: Broadcast) -> tuple[Codes, Model]:
    """Codes and model, made once in each Python worker that needs them."""
    hold(_ready.clear)
    if key not in _ready:
        _ready.clear()
        packed, weights, refined = learned.value
        # copied, as numpy asks for large pages, which makes looking up faster
        _ready[key] = Codes(*words.value), Model(np.frombuffer(zlib.decompress(packed), np.uint16).copy(), weights, refined)
    return _ready[key]


@dataclass
class Scored:
    """By text: log10 of its numbers' probability, the base's sum over its numbered words, how many those are, its other words."""

    logs: np.ndarray
    base: np.ndarray
    known: np.ndarray
    rest: list[dict[bytes, int]]


def scored_texts(codes: Codes, tables: Tables, model: Model, base: np.ndarray, texts: list[list[bytes]] | Numbered) -> Scored:
    """``texts`` with their ends; ``base``: the base's logarithm of each number."""
    texts = texts if isinstance(texts, Numbered) else numbered_lists(texts, codes)
    n = len(texts.starts) - 1
    out = Scored(np.zeros(n), np.zeros(n), np.zeros(n, np.int64), [{} for _ in range(n)])
    for part in parts([texts], codes, SCORE_WORDS):
        logs = model.logs(0, *number_choices(codes, tables, part.ids, part.first, part.lead))
        ids = part.ids[part.lead :]
        other = ids == codes.spelled
        if part.spelled:
            for text, word in zip(part.text_of[other].tolist(), part.spelled):
                rest = out.rest[text]
                rest[word] = rest.get(word, 0) + 1
        out.logs += np.bincount(part.text_of, weights=logs, minlength=n)
        out.base += np.bincount(part.text_of, weights=base[ids], minlength=n)
        out.known += np.bincount(part.text_of[~other], minlength=n)
    return out


def rare_words(tail: DataFrame, words: DataFrame, spelled: DataFrame, total: int, once: int, occurrences: int) -> DataFrame:
    """Sums over each row's words without numbers: ``row, rest_base, rest_known, rest_score``.

    ``words`` (word, n) has the training words, ``spelled`` (word, spelling) the others.  Rare words have ``occurrences`` in
    training, ``once`` of them of words met once.  With one occurrence left out these would be unknown: so large a part of what
    has no number is taken to be, and the rest is shared by count.
    """
    unknown = (once + 1) / (occurrences + 2)
    all_words = words.select("word", "n", F.lit(0.0).alias("spelling")).unionByName(spelled.select("word", F.lit(0).cast("long").alias("n"), "spelling"))
    n = F.col("n")
    score = F.when(n > 0, F.log10((1 - unknown) * n / max(occurrences, 1))).otherwise(math.log10(unknown) + F.col("spelling"))
    joined = tail.join(all_words, "word").select("row", (F.col("k") * F.log10((n + 1) / total)).alias("base"), F.when(n > 0, F.col("k")).otherwise(0).alias("known"), (F.col("k") * score).alias("score"))
    return joined.groupBy("row").agg(F.sum("base").alias("rest_base"), F.sum("known").alias("rest_known"), F.sum("score").alias("rest_score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row.

    Learns from the rows whose fold, crc32 of the id modulo ``modulus``, is not ``remainder``.  A null text counts as
    empty: one token, its end.  A null id counts as the empty text when folds are made.  Repeated rows are learned from as
    often as they occur and score alike.  Very long texts are read in pieces.  Other columns are not read.  An empty table
    gives no rows; with no training rows nothing is known and the bit predictors say one half.  Bits go by the text's UTF-8
    bytes and one more for its end.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out_fold = held_out("doc_id", modulus, remainder)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = materialize(word_counts(rows.where(~out_fold), "text"), "lm-words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    n, v = int(totals["n"]), int(totals["v"])
    head = words.where(F.col("n") > RARE).orderBy(F.col("n").desc(), "word").limit(HEAD - 1).toArrow()
    counts = head.column("n").to_numpy()
    ordered, number = in_order(head.column("word").to_pylist(), counts, n - int(counts.sum()))
    by_number = np.zeros(len(ordered) + 1)
    by_number[number] = np.log10((counts + 1) / (n + v + 1))
    of_number = np.full(len(ordered), n - counts.sum(), np.int64)  # what is left has no number
    of_number[number - 1] = counts
    sent, tables = spark.sparkContext.broadcast((pa.array(ordered, pa.large_binary()), of_number)), tables_for(n)
    texts = rows.where(~out_fold).select("text")
    texts = texts.coalesce(learning_tasks(texts))
    rare = words.where(F.col("n") <= RARE).select("word")
    rare = rare.coalesce(learning_tasks(rare))
    learned, bases, key = spark.sparkContext.broadcast(fit(texts, rare, sent, tables)), spark.sparkContext.broadcast(by_number), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = ready(key, sent, learned)
        for batch in batches:
            words, starts = split(batch.column(2))
            found = scored_texts(codes, tables, model, bases.value, numbered(words, starts, codes))
            tail = [list(rest.items()) for rest in found.rest]
            columns = [
                pa.array([uuid.uuid4().hex for _ in tail], pa.string()),
                pa.array(np.diff(starts)),
                pc.add(pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64()), 1),
                pa.array(found.known),
                pa.array(found.base),
                pa.array(tail, pa.map_(pa.binary(), pa.int64())),
                pa.array(found.logs),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "row", "n_tokens", "bytes", "head_known", "head_base", "tail", "head_score"])

    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.select("doc_id", out_fold.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, row string, n_tokens long, bytes long, head_known long, head_base double, tail map<binary, bigint>, head_score double")
    scored = materialize(scored, "lm-scored")
    tail = scored.select("row", F.explode("tail").alias("word", "k"))
    unknown = scored.where("held_out").select(F.explode(F.map_keys("tail")).alias("word")).distinct().join(words, "word", "left_anti")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = ready(key, sent, learned)
        for batch in batches:
            for some in by_bytes(batch.column(0).to_pylist(), LETTERS):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(model.logs(1, *letter_choices(codes, tables, some)))], names=["word", "spelling"])

    spelled = materialize(unknown.mapInArrow(spell, "word binary, spelling double"), "lm-spelled")
    rest = rare_words(tail, words, spelled, n + v + 1, int(totals["once"]), n - int(counts.sum()))
    out = scored.drop("tail").join(rest, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    score = plus("head_score", "rest_score", 0.0)
    return out.select("doc_id", "held_out", "n_tokens", plus("head_known", "rest_known", 0).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("head_base", "rest_base", 0.0).alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))
