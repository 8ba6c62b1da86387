"""Adaptive context-mixing range coder for sequences of token ids.

A block of ids is coded by itself.  Three orders predict the next id: order 2
and order 1 by the id that followed last after the same two ids or the same id
(with a confidence that grows with hits and falls with misses), order 0 by the
ids' frequencies.  The predictions are mixed: each order's weight adapts after
every id by what it would have given that id, apart for each pair of
confidences, and the id's share of the mixture is the interval that a range
coder narrows.  The order-0 frequencies start from those of the whole file and
take in the block's own counts at ids 32, 128, 512, ...

Blocks are independent, so many are coded at a time, one id of each per step
("lanes" of NumPy arrays); the bytes of a block do not depend on the others
that are coded with it.  All model arithmetic is on integers, or on doubles
whose operations IEEE 754 fixes, so that a reader on another machine has the
same model.
"""

from __future__ import annotations

import numpy as np

FIRST_REFRESH = 32
TOTAL_BITS = 28                      # the mixture's shares are parts of 2**28
WEIGHT_ONE = 64000                   # the most that orders 1 and 2 weigh together, of 65536
RATE = 4                             # weights move by 1/16 of their error
ORDER1_BITS, ORDER2_BITS = 11, 11    # slots per block
LOOKUP_BITS = 12                     # entries per block that lead to an order-0 share
CELLS = 1 << 24                      # order-0 table entries of the lanes coded at a time
MOST_LANES = 4096
PRIOR = 256 << 8                     # the file's frequencies weigh as 256 ids

_U64 = np.uint64
_TOTAL, _SETTLED, _LEAST = 1 << TOTAL_BITS, _U64(1 << 48), _U64(1 << 44)
_WORD, _TOP = _U64(16), _U64(48)
#: Chance that a prediction of each confidence comes true, before any evidence.
_HITS2, _HITS1 = (0.1, 0.4, 0.6, 0.8), (0.05, 0.2, 0.4, 0.6)


def lanes_for(alphabet: int) -> int:
    """Blocks that are coded at a time."""
    return max(16, min(MOST_LANES, CELLS // (alphabet + 1)))


def _first_weights(lanes: int) -> np.ndarray:
    """Pairs of 32-bit weights, of order 2 and of order 1, as one 64-bit entry."""
    pairs = []
    for a in _HITS2:
        for b in _HITS1:
            pairs += [(a, (1 - a) * b), (1 - (1 - a) * (1 - b), 0.0)]    # apart, and in agreement
    return np.tile((np.array(pairs) * WEIGHT_ONE).astype(np.int32).reshape(-1).view(np.int64), lanes)


#: What a weight pair moves to when order 2 and order 1 did (2) or did not (1) foresee the id.
_AIMS = np.array([(0, 0), (WEIGHT_ONE, 0), (0, WEIGHT_ONE), (WEIGHT_ONE, 0)], np.int32).reshape(-1).view(np.int64)
#: What a cell grows by, per confidence, after a miss and after a hit.
_GROWTH = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class Mixer:
    """The model of each lane: what the next id's shares are, and what it learns.
    Arrays of two rows hold order 2 in the first and order 1 in the second."""

    def __init__(self, lanes: int, longest: int, counts: np.ndarray, decodes: bool = False):
        alphabet = len(counts)
        self.size, self.decodes, self.longest = alphabet, decodes, longest
        self.bits = max(16, int(alphabet).bit_length() + 2)
        slots1 = min(1 << ORDER1_BITS, 1 << max(1, int(alphabet - 1).bit_length()))
        self.mask1 = slots1 - 1
        cell = np.uint16 if alphabet <= 1 << 14 else np.int32      # an id and its confidence, two bits
        self.last, self.growth = np.zeros(lanes * ((1 << ORDER2_BITS) + slots1), cell), _GROWTH.astype(cell)
        self.weights = _first_weights(lanes)
        counts = counts.astype(np.int64)
        self.prior = (counts * PRIOR // max(1, int(counts.sum()))).astype(float)
        self.seen = np.zeros((lanes, alphabet), np.uint16 if longest < 1 << 16 else np.int32)
        # Every share is 1 wide at least; an edge is held less its number.
        self.edges = np.zeros((lanes, alphabet + 1), np.uint16 if self.bits == 16 else np.int32)
        number = np.arange(lanes, dtype=np.int64)
        small = np.uint16 if alphabet <= 1 << 16 else np.int32
        self.starts = np.zeros((lanes, (1 << LOOKUP_BITS) + 1), small) if decodes else None
        self.numbers = np.arange(alphabet).astype(small)
        self.base = [number * alphabet, number * (alphabet + 1), (lanes << ORDER2_BITS) + number * slots1,
                     number << ORDER2_BITS, number * 32, number * ((1 << LOOKUP_BITS) + 1)]
        self.before = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        self.flat, self.flat_seen = self.edges.ravel(), self.seen.ravel()
        self.flat_starts = self.starts.ravel() if decodes else None
        self.refresh(1)
        self.edges[1:] = self.edges[0]
        if decodes:
            self.starts[1:] = self.starts[0]
        self._room(lanes)

    def _room(self, lanes: int) -> None:
        self.final = self.base[1] + self.size
        self.at, self.places, self.code = (np.empty((2, lanes), np.int64) for _ in range(3))

    def keep(self, lanes: int) -> None:
        self.base = [b[:lanes] for b in self.base]
        self.before, self.before2 = self.before[:lanes], self.before2[:lanes]
        self._room(lanes)

    def refresh(self, lanes: int) -> None:
        """Order-0 intervals from the file's frequencies and the block's counts."""
        room = (1 << self.bits) - self.size - 1
        step = max(1, (1 << 17) // self.size)
        for i in range(0, lanes, step):
            share = self.seen[i:min(i + step, lanes)].astype(float)
            share *= 256.0
            share += self.prior
            share *= (room / np.maximum(share.sum(1), 1.0))[:, None]
            edges = self.edges[i:i + len(share)]
            widths = share.astype(edges.dtype)                 # rounds down
            np.cumsum(widths, axis=1, dtype=edges.dtype, out=edges[:, 1:])
            edges[:, 0], edges[:, -1] = 0, (1 << self.bits) - self.size
            if self.decodes:
                self._index(i, edges)

    def _index(self, first: int, edges: np.ndarray) -> None:
        """Per lookup entry the share that holds its start."""
        shift = self.bits - LOOKUP_BITS
        starts = self.starts[first:first + len(edges)]
        starts[:] = 0
        entry = edges[:, :-1] + np.arange((1 << shift) - 1, (1 << shift) - 1 + self.size, dtype=np.int32)
        entry >>= shift                                        # the first entry that a share's start is not after
        entry = entry + (np.arange(len(edges)) * starts.shape[1])[:, None]
        starts.ravel()[entry.ravel()] = np.tile(self.numbers, len(edges))  # of several shares the last one stays
        np.maximum.accumulate(starts, axis=1, out=starts)

    def predict(self) -> None:
        """Shares ``top2``, ``top1`` of the predictions (of 2**28) and ``rest``."""
        at2, at1 = self.at
        np.bitwise_and(self.before, self.mask1, out=at1)
        at1 += self.base[2]
        np.multiply(self.before2, 0x9E3779B1, out=at2)
        at2 += self.before * 0x2545F491
        at2 >>= 13
        at2 &= (1 << ORDER2_BITS) - 1
        at2 += self.base[3]
        self.cells = self.last.take(self.at)
        self.guesses, self.sure = (self.cells >> 2).astype(np.int64), self.cells & 3
        agree = self.guesses[0] == self.guesses[1]
        chosen = (self.sure[0] << 2) + self.sure[1]            # of 16 pairs of confidences
        chosen <<= 1
        chosen += agree
        self.chosen = self.base[4] + chosen
        self.pair = self.weights.take(self.chosen).view(np.int32)
        top = self.pair + np.int32(1)
        top <<= 12
        self.top2 = top[::2].astype(np.int64)
        self.guessed = top[1::2] * ~agree + self.top2
        self.rest = _TOTAL - self.guessed

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the ids' shares."""
        np.add(self.base[1], ids, out=self.places[0])
        np.add(self.places[0], 1, out=self.places[1])
        ends = self.flat.take(self.places) + ids
        ends[1] += 1
        ends *= self.rest
        ends >>= self.bits
        ends += self.guessed
        self.hits = ids == self.guesses
        hit2, hit1 = self.hits
        low = np.where(hit1, self.top2, ends[0])
        low *= ~hit2
        high = np.where(hit2, self.top2, np.where(hit1, self.guessed, ends[1]))
        high -= low
        return low, high

    def find(self, target: np.ndarray) -> np.ndarray:
        """The ids whose shares hold ``target``."""
        # Exact: the quotient of numbers below 2**50 by one below 2**28 is
        # further from the next integer than a double's rounding.
        wanted = target - self.guessed
        np.maximum(wanted, 0, out=wanted)
        wanted += 1
        wanted <<= self.bits
        wanted -= 1
        wanted = (wanted / self.rest).astype(np.int64)
        entry = wanted >> (self.bits - LOOKUP_BITS)
        entry += self.base[5]
        place = self.flat_starts.take(entry) + self.base[1]
        wanted += self.base[1]
        after = place + 1
        behind = np.flatnonzero(self.flat.take(after) <= wanted - after)
        if len(behind):                                        # at most as many shares on as may start in an entry
            here, goal, final = after.take(behind), wanted.take(behind), self.final.take(behind)
            stride = 1 << (self.bits - LOOKUP_BITS)
            while stride > 1:
                stride >>= 1
                after = np.minimum(here + stride, final)
                here = np.where(self.flat.take(after) <= goal - after, after, here)
            place[behind] = here
        ids = np.where(target < self.guessed, self.guesses[1], place - self.base[1])
        return np.where(target < self.top2, self.guesses[0], ids)

    def learn(self, ids: np.ndarray, counts: bool) -> None:
        """``counts``: whether another refresh will read the block's counts."""
        hits = self.hits.view(np.int8)
        moved = _AIMS.take((hits[1] << 1) + hits[0]).view(np.int32)
        moved -= self.pair
        moved >>= RATE
        moved += self.pair
        self.weights[self.chosen] = moved.view(np.int64)
        np.multiply(hits, 4, out=self.code)
        self.code += self.sure
        cells = self.growth.take(self.code)
        cells += self.cells
        fresh = ((ids << 2) + 1).astype(cells.dtype)
        self.last[self.at.ravel()] = np.where(self.code == 0, fresh, cells).ravel()
        if counts:
            self.flat_seen[self.base[0] + ids] += 1
        self.before2, self.before = self.before, ids


def _unsettled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose first word is settled, or whose interval is too narrow to go
    on; one that is narrow across a word's end is cut there, in ``span``."""
    differ = low + span
    differ ^= low
    settled, narrow = differ < _SETTLED, span < _LEAST
    across = np.flatnonzero(narrow > settled)
    if len(across):
        span[across] = (~low.take(across) + _U64(1)) & (_LEAST - _U64(1))
    return np.flatnonzero(settled | narrow)


def _shifted(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals once a word is out, and those that are unsettled again: they
    are narrower than a settled one."""
    low, span = low << _WORD, span << _WORD
    return low, span, _unsettled(low, span) if span.min() < _SETTLED else _NONE


_NONE = np.zeros(0, np.int64)


class Encoder:
    def __init__(self, lanes: int, longest: int):
        self.low = np.zeros(lanes, _U64)
        self.range = np.full(lanes, (1 << 64) - 1, _U64)
        self.words = np.zeros((lanes, 2 * longest + 16), np.uint16)
        self.flat = self.words.ravel()
        self.first = np.arange(lanes, dtype=np.int64) * self.words.shape[1]
        self.next = self.first.copy()

    @property
    def used(self) -> np.ndarray:
        return self.next - self.first

    def keep(self, lanes: int) -> None:
        self.low, self.range = self.low[:lanes], self.range[:lanes]

    def narrow(self, start: np.ndarray, width: np.ndarray) -> None:
        unit = self.range >> _U64(TOTAL_BITS)
        self.low += unit * start.view(_U64)
        np.multiply(unit, width.view(_U64), out=self.range)
        at = _unsettled(self.low, self.range)
        while len(at):
            low, span, place = self.low.take(at), self.range.take(at), self.next.take(at)
            self.flat[place] = low >> _TOP
            self.next[at] = place + 1
            low, span, again = _shifted(low, span)
            self.low[at], self.range[at] = low, span
            at = at[again]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        most = max((len(p) for p in payloads), default=0) // 2 + 20
        self.words = np.zeros((len(payloads), most), np.uint16)
        for row, p in zip(self.words, payloads):
            row[:len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
        self.low = np.zeros(len(payloads), _U64)
        self.range = np.full(len(payloads), (1 << 64) - 1, _U64)
        self.code = np.zeros(len(payloads), _U64)
        for i in range(4):
            self.code = (self.code << _WORD) | self.words[:, i]
        self.flat = self.words.ravel()
        self.next = np.arange(len(payloads), dtype=np.int64) * most + 4

    def keep(self, lanes: int) -> None:
        self.low, self.range, self.code = self.low[:lanes], self.range[:lanes], self.code[:lanes]

    def target(self) -> np.ndarray:
        self.unit = self.range >> _U64(TOTAL_BITS)
        return np.minimum((self.code - self.low) // self.unit, _U64(_TOTAL - 1)).view(np.int64)

    def narrow(self, start: np.ndarray, width: np.ndarray) -> None:
        self.low += self.unit * start.view(_U64)
        np.multiply(self.unit, width.view(_U64), out=self.range)
        at = _unsettled(self.low, self.range)
        while len(at):
            low, span, place = self.low.take(at), self.range.take(at), self.next.take(at)
            # A damaged block may ask for words past its zeros; the checksum tells.
            self.code[at] = (self.code.take(at) << _WORD) | self.flat.take(place, mode="clip")
            self.next[at] = place + 1
            low, span, again = _shifted(low, span)
            self.low[at], self.range[at] = low, span
            at = at[again]


def _steps(lengths: np.ndarray, mixer: Mixer, coder):
    """Step numbers with the count of lanes that have an id there, and whether
    a refresh follows; lanes come longest first."""
    refresh, lanes = FIRST_REFRESH, len(lengths)
    longest = int(lengths[0]) if lanes else 0
    for t in range(longest):
        if lengths[lanes - 1] <= t:
            lanes = int(np.searchsorted(-lengths, -t, "left"))
            mixer.keep(lanes)
            coder.keep(lanes)
        if t == refresh:
            mixer.refresh(lanes)
            refresh *= 4
        mixer.predict()
        yield t, lanes, refresh < longest


def _end(low: int, span: int) -> bytes:
    """The fewest words that, with zeros after them, lie in the last interval."""
    for n in range(1, 5):
        unit = 1 << (64 - 16 * n)
        value = -(-low // unit) * unit
        if value < 1 << 64 and value - low < span:
            return b"".join(((value >> (48 - 16 * i)) & 0xFFFF).to_bytes(2, "little") for i in range(n))
    raise AssertionError("an interval holds its own start")


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bytes of consecutive blocks of ``ids``; ``lengths`` falls or stays.
    Ids are below ``len(counts)``, the file's frequencies."""
    out: list[bytes] = []
    at, lanes = 0, lanes_for(len(counts))
    for i in range(0, len(lengths), lanes):
        part = lengths[i:i + lanes]
        longest = int(part[0])
        table = np.zeros((longest, len(part)), np.int32)
        for j, n in enumerate(part.tolist()):
            table[:n, j] = ids[at:at + n]
            at += n
        mixer, coder = Mixer(len(part), longest, counts), Encoder(len(part), longest)
        low, span = coder.low, coder.range
        for t, k, counted in _steps(part, mixer, coder):
            row = table[t, :k].astype(np.int64)
            coder.narrow(*mixer.interval(row))
            mixer.learn(row, counted)
        for j, used in enumerate(coder.used.tolist()):
            out.append(coder.words[j, :used].astype("<u2").tobytes() + _end(int(low[j]), int(span[j])))
    return out


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What ``encode_blocks`` was given."""
    out, lanes = [], lanes_for(len(counts))
    for i in range(0, len(lengths), lanes):
        part = lengths[i:i + lanes]
        table = np.zeros((int(part[0]), len(part)), np.int32)
        mixer, coder = Mixer(len(part), int(part[0]), counts, decodes=True), Decoder(payloads[i:i + lanes])
        for t, k, counted in _steps(part, mixer, coder):
            row = mixer.find(coder.target())
            coder.narrow(*mixer.interval(row))
            mixer.learn(row, counted)
            table[t, :k] = row
        out += [table[:n, j] for j, n in enumerate(part.tolist())]
    return np.concatenate(out) if out else np.zeros(0, np.int32)
