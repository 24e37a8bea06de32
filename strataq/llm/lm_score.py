"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and one end.  Each token is coded by
binary decisions, in this order, until one settles it:

* *match*: is it the word that followed the same ``ORDER`` words elsewhere in
  the training texts?
* *known*: is it a word of the training texts?  If so, it is coded by its share
  of their tokens;
* else it is spelled: its UTF-8 bytes and a closing byte, bit by bit, most
  significant first.

Every decision and every bit is predicted from the counts of zeros and ones
seen in several hashed contexts: of decisions the last outcomes, the previous
word, the previous two, and the share of new words so far; of bits the last 2
or 3 bytes, across words, and the bytes of this word.  The predictions' logits
are combined with weights that a gate selects, and an adaptive map refines the
result.  The total is the text's score; ``bits_per_byte`` is that in bits, by
``n_bytes``, the bytes of the lower-cased words, a closing byte each, and the
end.  Case and kinds of white space are not coded.

Matches come from all training texts, and are looked up at every place that has
``ORDER`` words (``GAP`` is 1): such a place is an anchor, and the word behind it
its run.  What an anchor leads to is the run that most training texts have
there.  Anchors are named by ``KEY_BITS`` bits of their words' hash; runs are
compared by 16-bit hashes of their words.

A training text is scored as if it were held out, at each place: a place's own
count is taken from its word's, and its own run from its anchor's.

Every token of every training text is learnt, as often as it comes: tasks go
through their texts online and predict a stretch before they count it; then
counts and hits of the map are summed, and weights are averaged by the bits
they have learnt from.  So weights depend on how rows are dealt to tasks.
Every token of every text is then scored where it stands, by the merged model.

Plan: one pass over the texts writes blocks (a dictionary of words, and each
document's words as places in it) to the shared folder; dictionaries and
anchors, which repeat at most once a block whatever their frequency, are dealt
by hash to buckets, whose number follows the input; counts and matches go back
to the blocks by a cogroup, which finds the anchors anew, so that no block
stores them.  One pass over the blocks learns and one scores.
Only the bit tables, of fixed size, and the tasks' mixers reach the driver.

The base score is that of a word model with additive smoothing, exact over all
training tokens.

Defined cases: a null text is empty, and has one token, the end; rows that
repeat are learnt and scored each, and match each other; a null id hashes as
the empty text; without training texts the base is log10(0.1 / 0.1) = 0 for
each token (N and V are 0) and all words are spelled, by predictors that know
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm._store import drop, kept
from strataq.llm._text import mix, slices, words_of
from strataq.llm.toxicity import remainder

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # of text, for each bucket
KEYS_AT_ONCE = 1 << 18
TOKENS_A_PART = 12_000_000
PART = 1 << 16  # tokens that are worked on at once, or one longer text
CHUNK = 1 << 17
STEP, RATE, MOST = 4096, 0.002, 0.05  # bits a step; a weight moves by its mean error times RATE a bit, MOST at most
PRIOR = 50  # bits that the map's first values count for
LEVELS, CLIP = 33, 8.0
RANGE = 1 << 14  # decisions, or bits, that are predicted before they are counted
ORDER, GAP, RUN = 3, 1, 64
KEY_BITS = 48
END = ""  # as an empty word, whose code is the closing byte alone
SMALL = 0.1
SEEN = np.array([1, 4, 16, 256])  # bounds of the gate's classes of how often the longest context was seen
PLACES = 4
_SALT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.uint64(1)
_CLOSING = ord(" ")
_LEAD = 3  # bytes before a word that its contexts see

MATCH, KNOWN = range(2)
_HIT, _OLD, _NEW, _NONE = range(4)  # how a token is settled; the last: there is none
_CLASS = np.log2(np.arange(1, 1 << 12)).astype(np.int32)


@dataclass(frozen=True)
class Kind:
    """Sizes of one set of predictors: slots of each context's table as powers of two, gates, and rows of the map."""

    tables: tuple[int, ...]
    gates: int
    rows: int

    @property
    def starts(self) -> list[int]:
        """Each table's first slot, and all tables' size."""
        return [0, *accumulate(1 << b for b in self.tables)]

    @property
    def slots(self) -> int:
        return self.starts[-1]

    @property
    def contexts(self) -> int:
        return len(self.tables)


DECISIONS = Kind((13, 20, 20, 16), 20, 2 * 4)
BITS = Kind((18, 20, 20), (len(SEEN) + 1) * PLACES, 256)
SLOTS = DECISIONS.slots + BITS.slots


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(p / (1 - p)), -CLIP, CLIP)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


# --- mixing ---------------------------------------------------------------------------------------


class Mixer:
    """Gated weights and the adaptive map."""

    def __init__(self, kind: Kind) -> None:
        self.kind = kind
        self.weights = np.full((kind.gates, kind.contexts), 0.4, np.float32)
        self.map = np.tile(_squash(np.linspace(-CLIP, CLIP, LEVELS, dtype=np.float32)), (kind.rows, 1))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        logit = np.zeros(x.shape[1], np.float32)
        for k in range(self.kind.contexts):
            logit += x[k] * self.weights[:, k][gate]
        return np.clip(logit, -CLIP, CLIP)

    def refined(self, logit: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The final probability of a one."""
        at = (logit + np.float32(CLIP)) * np.float32((LEVELS - 1) / (2 * CLIP))
        low = np.minimum(at.astype(np.int32), LEVELS - 2)
        share = at - low
        place = row * LEVELS + low
        flat = self.map.ravel()
        p = (1 - share) * flat[place] + share * flat[place + 1]
        return np.clip((_squash(logit) + p) / 2, np.float32(1e-5), np.float32(1 - 1e-5))

    def cost(self, x: np.ndarray, gate: np.ndarray, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit."""
        p = self.refined(self.mixed(x, gate), row)
        return np.log10(np.where(bit, p, 1 - p))


class Learner:
    """Learns counts, weights and map of one kind from bits in order, each stretch predicted before it is counted."""

    def __init__(self, kind: Kind) -> None:
        self.kind = kind
        self.counts = np.zeros(kind.slots, np.int64)  # zeros, and ones times 2**32
        self.mixer = Mixer(kind)
        self.used = np.zeros(kind.gates)  # bits that each gate's weights have learnt from
        self.hits = np.zeros(kind.rows * LEVELS * 2, np.int64)  # zeros and ones at each entry of the map

    def learn(self, slots: np.ndarray, gate: np.ndarray | None, place: np.ndarray | None, row: np.ndarray, bit: np.ndarray) -> None:
        """``slots`` by context and bit. Without ``gate`` it is by ``place`` and how often the last context was seen."""
        seen = self.counts[slots].view(np.uint32)
        n0, n1 = np.add(seen[:, ::2], np.float32(0.4), dtype=np.float32), np.add(seen[:, 1::2], np.float32(0.4), dtype=np.float32)
        gate = _gate(n0[-1] + n1[-1], place) if gate is None else gate
        x = np.divide(n1, n0, out=n1)
        np.clip(np.log(x, out=x), -CLIP, CLIP, out=x)
        for k in range(0, len(bit), STEP):
            now = slice(k, k + STEP)
            self._step(x[:, now], gate[now], row[now], bit[now])
        one = np.where(bit, 1 << 32, 1)
        for at in slots:
            np.add.at(self.counts, at, one)

    def tables(self) -> np.ndarray:
        """Zeros and ones of all slots."""
        return np.stack((self.counts & 0xFFFFFFFF, self.counts >> 32)).astype(np.float32)

    def _step(self, x: np.ndarray, gate: np.ndarray, row: np.ndarray, bit: np.ndarray) -> None:
        mixer, kind = self.mixer, self.kind
        logit = mixer.mixed(x, gate)
        wrong = bit - _squash(logit)
        n = np.bincount(gate, minlength=kind.gates)
        rate = np.minimum(RATE * n, MOST) / np.maximum(n, 1)
        for k in range(kind.contexts):
            mixer.weights[:, k] += rate * np.bincount(gate, weights=wrong * x[k], minlength=kind.gates)
        self.used += n
        near = ((logit + np.float32(CLIP)) * np.float32((LEVELS - 1) / (2 * CLIP)) + np.float32(0.5)).astype(np.int32)
        self.hits += np.bincount((row * LEVELS + near) * 2 + bit, minlength=kind.rows * LEVELS * 2)

    def state(self) -> tuple[np.ndarray, ...]:
        return self.mixer.weights, self.used, self.hits


def _gate(seen: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.searchsorted(SEEN, seen, side="right") * PLACES + place


def _map(first: np.ndarray, hits: np.ndarray) -> np.ndarray:
    zeros, ones = np.moveaxis(hits.reshape(-1, LEVELS, 2), 2, 0)
    return ((PRIOR * first + ones) / (PRIOR + zeros + ones)).astype(np.float32)


def merged(kind: Kind, states: list[tuple[np.ndarray, ...]]) -> Mixer:
    """One mixer of all parts: weights by the bits they have learnt from, the map from summed counts."""
    mixer = Mixer(kind)
    if states:
        used = sum(s[1] for s in states)
        weights = sum(s[0] * s[1][:, None] for s in states) / np.maximum(used, 1)[:, None]
        mixer.weights = np.where(used[:, None] > 0, weights, mixer.weights).astype(np.float32)
        mixer.map = _map(mixer.map, sum(s[2] for s in states))
    return mixer


class Model:
    """Logits of all slots and both mixers, for scoring."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, decisions: list, bits: list) -> None:
        logits = _stretch((ones + 0.4) / (zeros + ones + 0.8)).astype(np.float32)
        self.logits = {DECISIONS: logits[: DECISIONS.slots], BITS: logits[DECISIONS.slots :]}
        self.seen = (zeros + ones)[DECISIONS.slots + BITS.starts[-2] :]
        self.mixers = {DECISIONS: merged(DECISIONS, decisions), BITS: merged(BITS, bits)}

    def __getstate__(self):
        return [self.logits[DECISIONS], self.logits[BITS], self.seen, self.mixers[DECISIONS].weights, self.mixers[DECISIONS].map, self.mixers[BITS].weights, self.mixers[BITS].map]

    def __setstate__(self, state) -> None:
        self.logits, self.seen, self.mixers = {DECISIONS: state[0], BITS: state[1]}, state[2], {DECISIONS: Mixer(DECISIONS), BITS: Mixer(BITS)}
        for kind, weights, map_ in ((DECISIONS, *state[3:5]), (BITS, *state[5:7])):
            self.mixers[kind].weights, self.mixers[kind].map = weights, map_

    def cost(self, kind: Kind, slots: np.ndarray, gate: np.ndarray | None, place: np.ndarray | None, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        if gate is None:
            gate = _gate(self.seen[slots[-1] - kind.starts[-2]], place)
        return self.mixers[kind].cost(self.logits[kind][slots], gate, row, bit)


# --- the decisions of texts -----------------------------------------------------------------------


def _expand(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _before(x: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """Of each token that of the one before in its text; else ``none``."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = none
    return out


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int32)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the words, and where each word starts in them (and the last one's end)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes times powers of a constant, from 0 on, and the powers of its inverse; differences, brought back, hash any stretch."""
    powers = np.cumprod(np.full(len(data), _SALT, np.uint64))
    backs = np.cumprod(np.full(len(data) + 1, _BACK, np.uint64))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _ONE) * powers))), backs


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words):
        return np.empty(0, np.uint64)
    data, offsets = _bytes_of(words)
    sums, backs = _sums(data[offsets[0] : offsets[-1]])
    at = offsets - offsets[0]
    return mix(mix((sums[at[1:]] - sums[at[:-1]]) * backs[at[:-1]]) + np.diff(at).astype(np.uint64))


class Words:
    """A dictionary with its counts in all training texts, their sum, and what spelling needs."""

    def __init__(self, words: pa.Array, counts: np.ndarray, total: int) -> None:
        self.counts, self.total, self.hashes = counts, total, hashes_of(words)
        self.text, self.offsets = _bytes_of(words)
        self.size = np.diff(self.offsets) + 1  # with the closing byte


class Tokens:
    """The tokens of whole texts with what is known of each place; gives the decisions and the spelled words.

    ``anchors`` are (place, state, words compared, hits as bits) of the anchors that lead to a run."""

    def __init__(self, words: Words, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray, anchors: tuple[np.ndarray, ...]) -> None:
        self.words, self.tokens, self.sizes, self.held = words, tokens, sizes, held
        starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.pos = pos = np.arange(len(tokens), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        own = np.repeat((~held).astype(np.int64), sizes)
        self.count = words.counts[tokens]
        left = self.count - own  # without the place itself
        status = np.where(left > 0, np.int8(_OLD), np.int8(_NEW))

        at, state, n, hits = anchors
        n = n.astype(np.int64)
        self.match = m = _expand(at + 1, n)
        step = (m - np.repeat(at + 1, n)).astype(np.uint64)
        state, hits = np.repeat(state, n).astype(np.int32), np.repeat(hits, n)
        hit = (hits >> step & _ONE).astype(bool)
        status[m[hit]] = _HIT
        self.status = status
        self.known = kn = np.flatnonzero(status >= _OLD)

        one = _before(words.hashes[tokens], starts, 0)
        two = _before(one, starts, 0)
        pair = mix(one * _SALT + two)
        p1 = _before(status, starts, _NONE)
        p2 = _before(p1, starts, _NONE)
        past = (p1 * np.int32(4) + p2) * np.int32(4) + _before(p2, starts, _NONE)
        is_new = (status == _NEW).astype(np.int32)
        new = np.cumsum(is_new, dtype=np.int32) - is_new
        new -= np.repeat(new[starts], sizes)
        rate = (32 * new.astype(np.int64) // np.maximum(pos, 1)).astype(np.int32) * 16 + _CLASS[np.minimum(pos, len(_CLASS) - 1)]
        back = np.minimum(step, np.uint64(6))
        run = ((hits & ((_ONE << step) - _ONE)) >> (step - back)).astype(np.int32) | 1 << back.astype(np.int32)
        self.p1 = p1 = p1.astype(np.int32)
        self.streams = (
            (MATCH, m, hit, (state * 128 + run, (one[m] ^ state.astype(np.uint64) * _SALT) * _BACK, pair[m], state * 64 + past[m]), state),
            (KNOWN, kn, status[kn] == _OLD, (past[kn], one[kn], ~pair[kn], rate[kn] * 4 + p1[kn]), 16 + p1[kn]),
        )
        settled = kn[status[kn] == _OLD]
        self.share = settled, np.log10(left[settled] / (words.total - own[settled]))

    def decisions(self) -> Iterator[tuple[np.ndarray, tuple]]:
        """(tokens, what a learner or model takes of their decisions), some tokens at a time."""
        for low in range(0, len(self.tokens), RANGE):
            for kind, at, bit, contexts, gate in self.streams:
                now = slice(*np.searchsorted(at, (low, low + RANGE)))
                if now.start < now.stop:
                    a, b, c, d = (x[now] for x in contexts)
                    base = DECISIONS.starts
                    slots = np.stack((a + kind * 4096, _top(b, DECISIONS.tables[1]) + base[1], _top(c, DECISIONS.tables[2]) + base[2], d + kind * 4096 + base[3]))
                    yield at[now], (slots, gate[now], None, kind * 4 + self.p1[at[now]], bit[now])

    def spelled(self) -> Iterator[tuple[np.ndarray, tuple]]:
        """(token of each bit, what a learner or model takes of the bits) of the words that are spelled."""
        at = self.known[self.status[self.known] == _NEW]
        ends = np.cumsum(self.words.size[self.tokens[at]])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RANGE // 8, side="right")))
            here = at[start:stop]
            start = stop
            led, n = self._led(here)
            word, place, data, contexts, last = spelling(led, n)
            bits, slots = bits_of(data, contexts)
            yield np.repeat(here[word], 8), (slots, None, np.repeat(np.minimum(place, PLACES - 1), 8), np.repeat(last, 8), bits)

    def _led(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the words ``here``, each behind the ``_LEAD`` bytes before it (0 where there are none), and the words' sizes."""
        text, offsets, size = self.words.text, self.words.offsets, self.words.size
        now = self.tokens[here]
        n = size[now]
        first = np.cumsum(n + _LEAD) - n
        led = np.zeros(int(n.sum()) + _LEAD * len(here), np.uint8)
        led[first + n - 1] = _CLOSING
        led[_expand(first, n - 1)] = text[_expand(offsets[now], n - 1)]
        past = np.flatnonzero(self.pos[here] > 0)
        previous = self.tokens[here[past] - 1]
        led[first[past] - 1] = _CLOSING
        for k in range(2, _LEAD + 1):
            some = size[previous] >= k
            led[first[past[some]] - k] = text[offsets[previous[some] + 1] - k + 1]
        return led, n


def spelling(led: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each byte of words of ``n`` bytes behind their leads: word, place, byte, contexts, and the byte before."""
    word = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n + _LEAD) - n
    at = _expand(starts, n)
    first = starts[word]
    data = led[at]
    last = [led[at - k].astype(np.uint64) for k in (1, 2, 3)]
    sums, backs = _sums(led)
    two = last[0] | last[1] << np.uint64(8)
    parts = (two, two | last[2] << np.uint64(16), (sums[at] - sums[first]) * backs[first])
    return word, at - first, data, [mix(c * _SALT + np.uint64(k + 1)) for k, c in enumerate(parts)], last[0].astype(np.int64)


def bits_of(data: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All bits in order, and each one's slot in each context. Half a byte's 15 slots are neighbours."""
    byte = data.astype(np.int32)
    bits = (byte[:, None] >> np.arange(7, -1, -1)) & 1
    high, low = byte >> 4, byte & 15
    nodes = np.stack([(1 << j % 4) | ((high if j < 4 else low) >> (4 - j % 4)) for j in range(8)], axis=1).astype(np.int32)
    slots = np.empty((BITS.contexts, len(byte), 8), np.int32)
    for k, c in enumerate(contexts):
        down = np.uint64(64 - BITS.tables[k] + 4)
        for half, h in ((0, c), (4, mix(c + (high + 16).astype(np.uint64) * _SALT))):
            base = ((h >> down) << np.uint64(4)).astype(np.int32) + np.int32(BITS.starts[k])
            np.add(base[:, None], nodes[:, half : half + 4], out=slots[k, :, half : half + 4])
    return bits.ravel().astype(bool), slots.reshape(BITS.contexts, -1)


def learn(tokens: Tokens, learners: dict[Kind, Learner]) -> None:
    for _, what in tokens.decisions():
        learners[DECISIONS].learn(*what)
    for _, what in tokens.spelled():
        learners[BITS].learn(*what)


def token_scores(tokens: Tokens, model: Model) -> np.ndarray:
    """log10 of each token's probability."""
    out = np.zeros(len(tokens.tokens))
    for at, what in tokens.decisions():
        out[at] += model.cost(DECISIONS, *what)
    at, share = tokens.share
    out[at] += share
    for at, what in tokens.spelled():
        out += np.bincount(at, weights=model.cost(BITS, *what), minlength=len(out))
    return out


# --- anchors and their runs -----------------------------------------------------------------------


def anchors_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, words in its run) of the anchors of texts of ``sizes`` tokens, the end included."""
    if len(hashes) <= ORDER:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    pos = np.arange(len(hashes)) - ends + np.repeat(sizes, sizes)
    key = hashes[ORDER - 1 :]
    for k in range(ORDER - 2, -1, -1):
        key = mix(key * _SALT + hashes[k : len(hashes) - ORDER + 1 + k])
    place = np.arange(ORDER - 1, len(hashes))
    is_one = (key % np.uint64(GAP) == 0) & (pos[place] >= ORDER - 1) | (pos[place] == ORDER - 1)
    is_one &= place < ends[place] - 1
    place, key = place[is_one], key[is_one]
    stop = np.minimum(ends[place] - 1, place + RUN)
    stop[:-1] = np.minimum(stop[:-1], place[1:])
    return place, key, stop - place


def _digests(runs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run."""
    if not len(n):
        return np.empty(0, np.uint64)
    starts = np.cumsum(n) - n
    step = np.arange(len(runs)) - np.repeat(starts, n)
    return mix(np.add.reduceat(mix(runs.astype(np.uint64) + (step.astype(np.uint64) + _ONE << np.uint64(16))), starts) + n.astype(np.uint64))


def expected_runs(key: np.ndarray, run: np.ndarray, n: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each record's anchor leads to, for a place of a training text (first) and of one held out (second): a state (0: nothing), words compared and hits.

    A record is an anchor's key and its run (``n`` words of ``run``) and how many training texts have it (``times``; records may repeat).
    A training place does not count itself. The run that most have is expected, of equals that of the least digest."""
    size = len(key)
    out = np.zeros((2, size), np.uint8), np.zeros((2, size), np.uint8), np.zeros((2, size), np.uint64)
    if not size:
        return out
    starts = np.cumsum(n) - n
    digest = _digests(run, n)
    order = np.lexsort((digest, key))
    k, d = key[order], digest[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_run = new_key | np.concatenate(([True], d[1:] != d[:-1]))
    of_run, of_key = np.cumsum(new_run) - 1, np.cumsum(new_key) - 1
    runs = np.flatnonzero(new_run)  # first record of each distinct run
    count = np.bincount(of_run, weights=times[order]).astype(np.int64)
    group = of_key[runs]
    whole = np.bincount(group, weights=count).astype(np.int64)
    best = np.lexsort((np.arange(len(runs)), -count, group))
    head = np.flatnonzero(np.concatenate(([True], group[best][1:] != group[best][:-1])))
    top = best[head]
    sizes = np.diff(np.append(head, len(best)))
    second = np.where(sizes > 1, best[np.minimum(head + 1, len(best) - 1)], -1)
    for t in (0, 1):
        own, g = of_run, of_key
        mine = 1 - t
        first, next_ = top[g], second[g]
        first_count = count[first] - np.where(first == own, mine, 0)
        next_count = np.where(next_ >= 0, count[next_], 0)
        better = next_count > first_count
        pick, support = np.where(better, next_, first), np.where(better, next_count, first_count)
        others = whole[g] - mine
        found = np.flatnonzero(support > 0)
        state = 1 + np.minimum(np.log2(np.maximum(support, 1)).astype(np.int64), 3) * 3 + (2 - (support == others) - (2 * support > others))
        at = order[found]
        leads = order[runs[pick[found]]]
        both = np.minimum(n[at], n[leads])
        whose = _expand(np.cumsum(both) - both, both)
        step = (whose - np.repeat(np.cumsum(both) - both, both)).astype(np.uint64)
        equal = run[_expand(starts[at], both)] == run[_expand(starts[leads], both)]
        hits = np.bitwise_or.reduceat(equal.astype(np.uint64) << step, np.cumsum(both) - both) if len(both) else np.empty(0, np.uint64)
        out[0][t, at], out[1][t, at], out[2][t, at] = state[found], both, hits
    return out


def expected(key: np.ndarray, run: np.ndarray, n: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``expected_runs``, some keys at a time; a key of one record that at most one training text has needs no search."""
    out = np.zeros((2, len(key)), np.uint8), np.zeros((2, len(key)), np.uint8), np.zeros((2, len(key)), np.uint64)
    if not len(key):
        return out
    starts = np.cumsum(n, dtype=np.int64) - n
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]], [True])))
    size = np.diff(edge)
    alone = order[edge[:-1][size == 1]]
    once = alone[times[alone] == 1]  # for a place held out, itself
    out[0][1, once], out[1][1, once], out[2][1, once] = 1, n[once], ~np.uint64(0) >> (np.uint64(64) - n[once].astype(np.uint64))
    some = np.repeat(size, size) > 1
    some[edge[:-1][size == 1]] = times[alone] > 1
    order = order[some]
    edge = np.flatnonzero(np.concatenate((key[order[1:]] != key[order[:-1]], [True]))) + 1 if len(order) else np.zeros(1, np.int64)
    low = 0
    while low < len(order):
        k = int(np.searchsorted(edge, low + KEYS_AT_ONCE, side="right"))
        high = int(edge[max(k - 1, np.searchsorted(edge, low, side="right"))])  # a key more, if it alone is larger
        at = order[low:high]
        many = n[at].astype(np.int64)
        for a, b in zip(out, expected_runs(key[at], run[_expand(starts[at], many)], many, times[at])):
            a[:, at] = b
        low = high
    return out


# --- the corpus ----------------------------------------------------------------------------------


def _list(values, ends) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _widened(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return _squeezed(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_widened(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """The words' bytes, and their lengths."""
    data, offsets = _bytes_of(words)
    return _squeezed(data[offsets[0] : offsets[-1]].tobytes()), _packed(np.diff(offsets).astype(np.int32))


def _unpacked_words(data: list[bytes], lengths: list[np.ndarray]) -> pa.Array:
    """The words of several packs."""
    n = np.concatenate([np.zeros(1, np.int32), *lengths])
    return pa.StringArray.from_buffers(len(n) - 1, pa.py_buffer(np.cumsum(n, dtype=np.int32)), pa.py_buffer(b"".join(map(_widened, data))))


def _records(flow: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """A block's anchors: their places, and each one's record; equal ones share one. Of the records, by ascending key: key, words of
    all runs, words in each, and how many training places have it."""
    place, key, n = anchors_of(flow, sizes)
    key >>= np.uint64(64 - KEY_BITS)
    run = (flow >> np.uint64(48)).astype(np.uint16)
    _, some, record = np.unique(mix(key * _SALT + _digests(run[_expand(place + 1, n)], n)), return_index=True, return_inverse=True)
    own = ~held[np.searchsorted(np.cumsum(sizes), place, side="right")]
    times = np.bincount(record, weights=own, minlength=len(some)).astype(np.int32)
    by = np.argsort(key[some], kind="stable")
    back = np.empty(len(by), np.int32)
    back[by] = np.arange(len(by))
    some = some[by]
    return place, back[record], (key[some], run[_expand(place[some] + 1, n[some])], n[some], times[by])


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return (key >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)


def _blocks(key: str, buckets: int):
    """Blocks of whole texts: documents, a dictionary in order of its words' buckets, and the documents' words as places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                words, sizes = words_of(part.column("text"))
                coded = pc.dictionary_encode(words)
                codes, distinct = coded.indices.to_numpy(zero_copy_only=False), pa.concat_arrays([coded.dictionary, pa.array([END])])
                order = np.argsort(_word_buckets(hashes_of(distinct), buckets), kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                tokens = np.insert(rank[codes], np.cumsum(sizes), rank[-1])
                texts = [_list(x, [0, part.num_rows]) for x in (part.column(key), part.column("held"), pa.array(sizes + 1, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *texts, *(pa.array([x], pa.binary()) for x in (_packed(tokens), *_packed_words(distinct.take(pa.array(order)))))], ["block", *_TEXT])
                number += 1
            pa.default_memory_pool().release_unused()

    return run


def _word_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _parts(buckets: int):
    """Of each block the parts of its dictionary and of its anchors' records that fall in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dictionary, tokens, sizes, held = _texts({c: batch.column(c)[k] for c in _TEXT})
                hashes, trained = hashes_of(dictionary), np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(dictionary))
                _, _, (keys, runs, n, times) = _records(hashes[tokens], sizes, held)
                every = np.arange(buckets + 1)
                cuts, ends = np.searchsorted(_word_buckets(hashes, buckets), every), np.searchsorted(_bucket_of(keys, buckets), every)
                first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
                for b in np.flatnonzero(np.diff(cuts) | np.diff(ends)).tolist():
                    i, j = slice(cuts[b], cuts[b + 1]), slice(ends[b], ends[b + 1])
                    anchors = (np.diff(keys[j], prepend=np.uint64(0)), n[j].astype(np.uint8), runs[first[j.start] : first[j.stop]], times[j])
                    packs = [*_packed_words(dictionary[i]), _packed(trained[i]), *map(_packed, anchors)]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), batch.column("block").slice(k, 1), *(pa.array([x], pa.binary()) for x in packs)], ["bucket", "block", *_PART])
            pa.default_memory_pool().release_unused()

    return run


_TEXT = ("ids", "held", "sizes", "tokens", "words", "lengths")
_PART = ("words", "lengths", "trained", "keys", "n", "runs", "times")


def _texts(row: dict[str, pa.Scalar]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's dictionary, tokens, sizes, and which texts are held out."""
    words = _unpacked_words([row["words"].as_py()], [_unpacked(row["lengths"].as_py(), np.int32)])
    return words, _unpacked(row["tokens"].as_py(), np.int32), row["sizes"].values.to_numpy().astype(np.int64), row["held"].values.to_numpy(zero_copy_only=False)


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's part in a bucket: its words' summed counts, and what its anchors lead to; then one row of sums."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    del rows
    column = lambda name: [x.as_py() for x in table.column(name)]
    lengths = [_unpacked(x, np.int32) for x in column("lengths")]
    coded = pc.dictionary_encode(_unpacked_words(column("words"), lengths))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, codes, np.concatenate([_unpacked(x, np.int64) for x in column("trained")]))
    joined = lambda name, kind: np.concatenate([_unpacked(x, kind) for x in column(name)])
    keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in column("keys")]
    records = list(map(len, keys))
    keys = np.concatenate(keys)
    state, n, hits = expected(keys, joined("runs", np.uint16), joined("n", np.uint8), joined("times", np.int32))
    i = j = 0
    for block, bucket, size, r in zip(column("block"), column("bucket"), map(len, lengths), records):
        yield _reply(block, bucket, total[codes[i : i + size]], state[:, j : j + r], n[:, j : j + r], hits[:, j : j + r])
        i, j = i + size, j + r
    yield _reply(-1, -1, np.array([total.sum(), np.count_nonzero(total)]), *(np.empty((2, 0), t) for t in (np.uint8, np.uint8, np.uint64)))
    del table, keys, total, state, n, hits
    pa.default_memory_pool().release_unused()


def _reply(block: int, bucket: int, counts: np.ndarray, *runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), *(pa.array([_packed(x)], pa.binary()) for x in (counts, *(x.T for x in runs)))], ["block", "bucket", "counts", "state", "n", "hits"])


_KINDS = {"counts": np.int64, "state": np.uint8, "n": np.uint8, "hits": np.uint64}


def _answered(block: pa.Table, replies: pa.Table) -> pa.Table:
    """A block with the counts of its words and what its anchors lead to, of those that lead to a run."""
    parts = replies.sort_by("bucket")
    counts, state, n, hits = (np.concatenate([_unpacked(x.as_py(), kind) for x in parts.column(name)]) for name, kind in _KINDS.items())
    out = block.drop_columns("block").combine_chunks()
    words, tokens, sizes, held = _texts({c: out.column(c)[0] for c in _TEXT})
    place, record, _ = _records(hashes_of(words)[tokens], sizes, held)
    record = 2 * record.astype(np.int64) + held[np.searchsorted(np.cumsum(sizes), place, side="right")]
    used = np.flatnonzero(state[record])
    place, record = place[used], record[used]
    for name, x in zip(_ANSWERS, (counts, np.diff(place, prepend=0).astype(np.int32), state[record], n[record], hits[record])):
        out = out.append_column(name, pa.array([_packed(x)], pa.binary()))
    return out


_ANSWERS = {"counts": np.int64, "at": np.int32, "state": np.uint8, "n": np.uint8, "hits": np.uint64}
_PLACES = ("state", "n", "hits")


def _read(batch: pa.RecordBatch, k: int, total: int) -> Iterator[Tokens]:
    """A block's tokens, some whole texts at a time."""
    dictionary, tokens, sizes, held = _texts({c: batch.column(c)[k] for c in _TEXT})
    at, *led = _places(batch, k)
    ends, at = np.cumsum(sizes), at.astype(np.int64)
    words = Words(dictionary, _unpacked(batch.column("counts")[k].as_py(), np.int64), total)
    first = 0
    while first < len(sizes):
        low = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, low + PART, side="right")))
        high = int(ends[last - 1])
        some = slice(*np.searchsorted(at, (low, high)))
        yield Tokens(words, tokens[low:high], sizes[first:last], held[first:last], (at[some] - low, *(x[some] for x in led)))
        first = last


def _places(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """The places of a block's anchors, and what they lead to."""
    at = np.cumsum(_unpacked(batch.column("at")[k].as_py(), np.int32), dtype=np.int32)
    return at, *(_unpacked(batch.column(c)[k].as_py(), _ANSWERS[c]) for c in _PLACES)


def _trained(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The block without its texts that are held out."""
    _, tokens, sizes, held = _texts({c: batch.column(c)[k] for c in _TEXT})
    at, *led = _places(batch, k)
    keep = np.repeat(~held, sizes)
    use = keep[at] if len(at) else np.zeros(0, bool)
    place = (np.cumsum(keep, dtype=np.int32) - 1)[at[use]]
    left, out = int(np.count_nonzero(~held)), batch.slice(k, 1)
    new = {name: pa.array([_packed(x)], pa.binary()) for name, x in (("tokens", tokens[keep]), ("at", np.diff(place, prepend=np.int32(0))), *((c, y[use]) for c, y in zip(_PLACES, led)))}
    new |= {"sizes": _list(pa.array(sizes[~held], pa.int32()), [0, left]), "held": _list(pa.array(np.zeros(left, bool)), [0, left])}
    for name, values in new.items():
        out = out.set_column(out.schema.get_field_index(name), name, values)
    return out


def _learning(total: int):
    """Learns every token of the training texts of a partition; rows of its bit counts, and one of the rest (at -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners = {kind: Learner(kind) for kind in (DECISIONS, BITS)}
        for batch in batches:
            for k in range(batch.num_rows):
                for tokens in _read(_trained(batch, k), 0, total):
                    learn(tokens, learners)
        part, first = TaskContext.get().partitionId(), 0
        for kind in (DECISIONS, BITS):
            counts = learners[kind].tables()
            for at in range(0, kind.slots, CHUNK):
                here = counts[:, at : at + CHUNK]
                if here.any():
                    yield _part(first + at, part, here.tobytes())
            first += kind.slots
        if any(x.used.any() for x in learners.values()):
            yield _part(-1 - part, part, pickle.dumps([learners[kind].state() for kind in (DECISIONS, BITS)]))

    return run


def _part(at: int, part: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int64()), pa.array([counts], pa.binary())], ["at", "part", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    if table.column("at")[0].as_py() < 0:  # a partition's mixers
        return table.select(["at", "part", "counts"])
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("counts"))
    return pa.table({"at": table.column("at").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _scoring(model, key: str, kind: pa.DataType, total: int, distinct: int):
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, at = batch.column("ids")[k].values, 0
                for tokens in _read(batch, k, total):
                    n = len(tokens.sizes)
                    base = np.log10((tokens.count + SMALL) / (total + SMALL * (distinct + 1)))
                    summed = lambda x: np.bincount(tokens.doc, weights=x, minlength=n)  # noqa: B023, E731
                    score, n_bytes = summed(token_scores(tokens, model.value)), summed(tokens.words.size[tokens.tokens])
                    values = (tokens.held, tokens.sizes, summed(tokens.count > 0).astype(np.int64), np.full(n, total), summed(base), score, n_bytes.astype(np.int64), -score / np.log10(2) / n_bytes)
                    yield pa.RecordBatch.from_arrays([ids.slice(at, n).cast(kind), *(pa.array(v, t) for v, t in zip(values, kinds))], names)
                    at += n

    return run


def score_texts(docs: DataFrame, held, key: str = "doc_id") -> DataFrame:
    """Scores of every row of ``docs`` (``key``, text), learnt from the rows where the column ``held`` is false."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, "text", F.coalesce(held, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    text = f"ids array<{kind}>, held array<boolean>, sizes array<int>, " + ", ".join(f"{c} binary" for c in _TEXT[3:])
    blocks, at_blocks = kept(rows.mapInArrow(_blocks(key, buckets), f"block long, {text}"), "lm-blocks")
    said = blocks.mapInArrow(_parts(buckets), "bucket long, block long, " + ", ".join(f"{c} binary" for c in _PART)).repartitionById(buckets, F.col("bucket").cast("int"))
    replies, at_replies = kept(said.mapInArrow(_replies, "block long, bucket long, " + ", ".join(f"{c} binary" for c in _KINDS)), "lm-replies")
    sums = np.zeros(2, np.int64)
    for r in replies.where("block < 0").select("counts").toLocalIterator():  # one row a bucket
        sums += _unpacked(r["counts"], np.int64)
    total, distinct = map(int, sums)

    schema = f"{text}, " + ", ".join(f"{c} binary" for c in _ANSWERS)
    answered, at_answered = kept(blocks.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(_answered, schema), "lm-answered")
    drop(spark, at_blocks, at_replies)

    parts = max(1, -(-total // TOKENS_A_PART))
    partial = answered.coalesce(parts).mapInArrow(_learning(total), "at long, part long, counts binary")
    if parts > 64:  # in two steps, so that no task holds all parts of a table
        partial = partial.groupBy("at", F.expr("part div 64")).applyInArrow(_summed, "at long, part long, counts binary")
    zeros, ones, states = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), {}
    for r in partial.groupBy("at").applyInArrow(_summed, "at long, part long, counts binary").toLocalIterator():  # tables of fixed size
        if r["at"] < 0:
            states[r["at"]] = pickle.loads(r["counts"])
            continue
        both = np.frombuffer(r["counts"], np.float32).reshape(2, -1)
        zeros[r["at"] : r["at"] + both.shape[1]], ones[r["at"] : r["at"] + both.shape[1]] = both
    ordered = [states[at] for at in sorted(states)]
    model = spark.sparkContext.broadcast(Model(zeros, ones, [s[0] for s in ordered], [s[1] for s in ordered]))

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    scored = answered.mapInArrow(_scoring(model, key, _arrow_type(docs, key), total, distinct), schema)
    result, _ = kept(scored, "lm-scores")
    drop(spark, at_answered)
    return result


def _arrow_type(docs: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[key].dataType)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learnt from nine tenths of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, remainder(F.col("doc_id"), 10) == 0)


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLE_SQL: dict[str, str] = {}
