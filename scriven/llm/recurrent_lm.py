"""Scoring with a gated recurrent language model.

Model.  The vocabulary grows with the corpus: it holds every word (see textcore) that occurs at
least sqrt(words of the corpus) / ``SHARE`` times, and twice.  An end mark closes every document
and starts the next.  A gated recurrent unit reads the words; the output is factored, a softmax
over classes of words and one over the words of the class.  Words are put into classes by
frequency rank (ties by hash); a class is full when its number of words times its share of the
corpus reaches ``FULL``, so frequent words have small classes, rare ones large classes, and a
step is expected to weigh ``FULL`` times as many words of a class as there are classes (with 1 it
weighs fewest, but in more and smaller products of matrices).

Spelling.  Words beyond the vocabulary are read as one unknown word and then spelled: their
probability is that of the unknown word times that of their letters, each given the two before
it, and of the word's end.  The letters' probabilities are counted over all occurrences of such
words in the corpus and interpolated (Witten-Bell) down to a uniform one over all letters and
numbers of Unicode, so every word has one of its own.  No count is cut off.  Spellings of words
of the vocabulary are not left out, so a little of the unknown word's probability is lost.

Training.  Truncated backpropagation through ``WINDOW`` steps (up to ``LONGER`` times more, as lanes run out) with Adagrad, in numpy, on
every document of the corpus: each document takes part in one of ``ROUNDS`` rounds, chosen by
a hash of its text.  In a round each task starts from the round's model and runs over its documents, all
lanes in step.  A document is read whole in one lane, its state carried from window to window
and cleared only where it ends; a lane that is done takes the task's next document, until none is
left.  That doesn't depend on the sizes of batches.  Tasks are merged until they hold
about ``TASK`` words, if there are more than run at a time.  The models are then averaged,
weighted by the words seen.  The average is a distributed sum over blocks of parameters, so
what reaches the driver is one model.

Scoring.  ``log_likelihood`` is the natural logarithm of the probability of the whole
document with its end mark: state is carried through all windows, nothing is cut off.
``perplexity`` is exp(-log_likelihood / (n_words + 1)).

Cases.  A null text has null scores; an empty text is the end mark alone.  Rows with a null
doc_id and repeated rows are scored like others, and count in training.  Other columns are
not read.  An empty table gives an empty result (the model is then untrained).
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import groups, materialize, table

SHARE = 32
#: Words of a class times the share of the corpus that they make up.
FULL = 2.0
WIDTH = 16
WINDOW = 16
#: Rows whose softmax is computed together.
ROWS = 1024
#: Steps times lanes whose gates are computed together.
SLAB = 512
#: Times WINDOW that a training window may span when few lanes are left.
LONGER = 16
ROUNDS = 2
RATE = 0.1
#: Parameters that are updated together, and averaged: a task reads one block of every model at a time.
BLOCK = 1 << 14
#: Words of a batch to score and lanes; a long document fills a lane alone, so batches are large.
BATCH = 3_000_000
#: Words of a task that trains or scores: its longest documents, which go on alone at its end, are then a small part of it.
TASK = 8_000_000
LANES = 512
U64 = np.uint64
f4 = np.float32
NAMES = ("embed", "gate_in", "gate_state", "gate_bias", "class_out", "word_out")


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's numbers."""
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in any order, and the sum of each one's numbers."""
    t = pa.table({"key": keys, "n": n}).group_by("key", use_threads=False).aggregate([("n", "sum")])
    return t["key"].to_numpy(), t["n_sum"].to_numpy()


class _Index:
    """Where distinct keys lie in their array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.given, self.shift, self.mask = keys, U64(64 - bits), (1 << bits) - 1
        self.keys, self.place = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        keys, rest = keys.view(U64), np.arange(len(keys))
        at = self._start(keys)
        while len(rest):
            free = self.place[at] < 0
            self.place[at[free]] = rest[free]  # of several that want a place one gets it
            mine = self.place[at] == rest
            self.keys[at[mine]] = keys[rest[mine]]
            rest, at = rest[~mine], (at[~mine] + 1) & self.mask

    def __reduce__(self) -> tuple:
        return _Index, (self.given,)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        keys = keys.view(U64)
        at = self._start(keys)
        out = self.place[at]
        rest = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            now = at[rest]
            out[rest] = self.place[now]
            rest = rest[(self.keys[now] != keys[rest]) & (out[rest] >= 0)]
        return out


#: Bits of a code point in a key, and a key of letters before and the letter; 0 is the start and the end of a word.
_BITS, _LAST = 21, (1 << 21) - 1


class Spelling:
    """Probabilities of letters given the two before, from the counts of triples."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        alphabet = int(tc._tables()[0].sum()) + 1
        one, n1 = _added(keys & _LAST, n)
        total, kinds = int(n1.sum()), len(one)
        self.never = 1 / alphabet * (kinds / (total + kinds) if total else 1)
        #: Of 1, 2 and 3 letters: keys, their probabilities, keys of what comes before and the weight of the shorter ones after it.
        self.levels = [(_Index(one), n1 / max(1, total + kinds) + self.never, None, None)]
        for k in (2, 3):
            gram, many = _added(keys & ((1 << _BITS * k) - 1), n)
            before, inverse = np.unique(gram >> _BITS, return_inverse=True)
            seen, kinds = np.bincount(inverse, many, len(before)), np.bincount(inverse, minlength=len(before))
            shorter = self.probability(gram & ((1 << _BITS * (k - 1)) - 1), k - 1)
            self.levels.append((_Index(gram), (many + kinds[inverse] * shorter) / (seen + kinds)[inverse], _Index(before), kinds / (seen + kinds)))

    def probability(self, keys: np.ndarray, k: int = 3) -> np.ndarray:
        gram, p, before, weight = self.levels[k - 1]
        at = gram.find(keys)
        there = at >= 0
        out = np.full(len(keys), self.never)
        out[there] = p[at[there]]
        if k > 1 and not there.all():
            rest = keys[~there]
            at = before.find(rest >> _BITS)
            known = at >= 0
            less = np.ones(len(rest))
            less[known] = weight[at[known]]
            out[~there] = less * self.probability(rest & ((1 << _BITS * (k - 1)) - 1), k - 1)
        return out


def _letters(words: tc.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the letters and the end of some words with the letters before, and which word each is of."""
    code = tc.points(words.joined).astype(np.int64)
    start, size = words.start[which], words.end[which] - words.start[which] + 1
    owner = np.repeat(np.arange(len(which)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + place
    own = np.where(place == size[owner] - 1, 0, code[at])
    return (np.where(place > 1, code[at - 2], 0) << 2 * _BITS) | (np.where(place > 0, code[at - 1], 0) << _BITS) | own, owner


@dataclass
class Model:
    """Parameters; class c has the words first[c] to first[c + 1]."""

    hashes: np.ndarray  # hashes of known words
    ids: np.ndarray  # their ids
    params: dict[str, np.ndarray]
    first: np.ndarray
    spelling: Spelling | None = None
    words: int = 0  # of all documents it was trained on

    def __post_init__(self) -> None:
        self.class_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.index = _Index(self.hashes)


END, UNKNOWN = 0, 1


def class_bounds(n: np.ndarray) -> np.ndarray:
    """The first word of each class, and their number, from the occurrences of words in order of frequency."""
    share = np.concatenate(([0], np.cumsum(np.maximum(n, 1) / np.maximum(n, 1).sum())))
    first = [0]
    while first[-1] < len(n):
        a = first[-1]
        cost = (share[a + 1 :] - share[a]) * np.arange(1, len(n) - a + 1)
        first.append(a + min(len(n) - a, int(np.searchsorted(cost, FULL)) + 1))
    return np.array(first)


def fresh(hashes: np.ndarray, first: np.ndarray | None = None, width: int = WIDTH, seed: int = 11) -> Model:
    """An untrained model; hashes in order of frequency, first as from class_bounds for END, UNKNOWN and the hashes."""
    g = np.random.default_rng(seed)
    size = len(hashes) + 2
    first = class_bounds(np.ones(size)) if first is None else first
    classes = len(first) - 1
    draw = lambda *shape: (g.normal(0, 1, shape) / np.sqrt(width)).astype(f4)
    order = np.argsort(hashes)
    params = {
        "embed": draw(size, width), "gate_in": draw(width, 3 * width), "gate_state": draw(width, 3 * width), "gate_bias": np.zeros(3 * width, f4),
        "class_out": draw(classes, width + 1), "word_out": draw(size, width + 1),
    }
    params["class_out"][:, -1] = params["word_out"][:, -1] = 0  # the biases
    return Model(hashes[order], (order + 2).astype(np.int32), params, first)


def word_ids(model: Model, words: np.ndarray) -> np.ndarray:
    return np.append(model.ids, np.int32(UNKNOWN))[model.index.find(words)]


@dataclass
class Window:
    """Some steps of the lanes that go on; all arrays are (steps, lanes)."""

    source: np.ndarray  # word read
    target: np.ndarray  # word to foresee
    go_on: np.ndarray  # 0 where a document begins and the state is cleared
    valid: np.ndarray
    doc: np.ndarray  # which document


def _windows(ids: list[np.ndarray], lanes: int = LANES) -> Iterator[Window]:
    """Documents one after the other in lanes of about equal length, all lanes in step; the first window's lanes include all later ones'."""
    size = np.array([len(x) + 1 for x in ids])
    lanes = max(1, min(lanes, len(ids)))
    load, placed = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = load[0]
        placed[k].append(i)
        heapq.heapreplace(load, (n + int(size[i]), k))
    placed.sort(key=lambda lane: -size[lane].sum())
    order = np.array([i for lane in placed for i in lane])
    flat = np.concatenate([np.append(ids[i], END) for i in order]).astype(np.int32)
    doc = np.repeat(order.astype(np.int32), size[order])
    starts = np.zeros(len(flat), bool)
    starts[np.cumsum(size[order]) - size[order]] = True
    read = np.roll(flat, 1)
    read[starts] = END
    go_on = (~starts).astype(f4)
    long = np.array([size[lane].sum() for lane in placed])
    begin = np.cumsum(long) - long
    for t in range(0, int(long[0]), WINDOW):
        n = int(np.searchsorted(-long, -t, side="left"))
        step = t + np.arange(min(WINDOW, int(long[0]) - t))[:, None]
        at = begin[None, :n] + np.minimum(step, long[None, :n] - 1)
        yield Window(read.take(at), flat.take(at), go_on.take(at), step < long[None, :n], doc.take(at))


def _refilled(docs: Iterator[np.ndarray], lanes: int = LANES) -> Iterator[tuple[np.ndarray, Window]]:
    """Documents in the order they come, each whole in one lane; a lane that is done takes the next, and when none is left windows get longer.  (lanes of the window before that go on, window)."""
    rest, at = [np.zeros(0, np.int64)] * lanes, [0] * lanes  # words to foresee, END last, and the next one
    last, own = np.full(lanes, END), np.zeros(lanes, np.int64)
    live, taken, first = np.arange(lanes), 0, 0
    while len(live):
        steps = WINDOW * min(LONGER, max(1, first // len(live)))
        target, doc = np.zeros((len(live), steps), np.int64), np.repeat(own[live][:, None], steps, axis=1)
        go_on, valid = np.ones((len(live), steps), f4), np.ones((len(live), steps), bool)
        for i, k in enumerate(live.tolist()):
            now, a, t = rest[k], at[k], 0
            if a + steps <= len(now):
                target[i], at[k] = now[a : a + steps], a + steps
                continue
            while True:
                n = min(len(now) - a, steps - t)
                target[i, t : t + n] = now[a : a + n]
                a, t = a + n, t + n
                if t == steps:
                    break
                ids = next(docs, None)
                if ids is None:
                    valid[i, t:] = False
                    break
                now, a = np.append(ids, END), 0
                go_on[i, t], doc[i, t:], own[k], taken = 0, taken, taken, taken + 1
            rest[k], at[k] = now, a
        source = np.empty_like(target)  # a document is read from END on, which closed the one before it
        source[:, 0], source[:, 1:], last[live] = last[live], target[:, :-1], target[:, -1]
        some = np.flatnonzero(valid[:, 0])
        if not len(some):
            return
        first = first or len(some)
        yield some, Window(source[some].T, target[some].T, go_on[some].T, valid[some].T, doc[some].T)
        live = live[some]


def _blocks(steps: int, n: int) -> Iterator[slice]:
    """Steps in runs whose arrays of ``n`` lanes stay in a core's cache from one numpy pass to the next."""
    size = max(1, SLAB // n)
    return (slice(t, min(steps, t + size)) for t in range(0, steps, size))


def _forward(p: dict, h: np.ndarray, x: Window, keep: bool = True):
    """States (steps, width, lanes) after each step, and with ``keep`` what the backward pass needs; lanes lie along the last axis so that each part is contiguous.

    Weights are scaled so that exp() takes what they give: a gate is 1 / (1 + exp(-a)), the hyperbolic tangent 2 / (1 + exp(-2 a)) - 1.
    """
    steps, n = x.source.shape
    w = len(h)
    scale = np.repeat(np.array([-1, -1, -2], h.dtype), w)[:, None]
    into, bias, turn = p["gate_in"].T * scale, p["gate_bias"][:, None] * scale, p["gate_state"].T * scale
    clear = (x.go_on == 0).any(axis=1).tolist()
    kept = steps if keep else 1
    states, zr, an, new = (np.empty((k, m * w, n), h.dtype) for k, m in ((steps, 1), (kept, 2), (kept, 1), (kept, 1)))
    embedded, at = [], np.empty((3 * w, n), h.dtype)
    with np.errstate(over="ignore"):
        for s in _blocks(steps, n):
            e = p["embed"].take(x.source[s].reshape(-1), axis=0).reshape(s.stop - s.start, n, w).transpose(0, 2, 1)
            gx = into @ e
            gx += bias
            if keep:
                embedded.append(e)
            for t, g in zip(range(s.start, s.stop), gx):
                if clear[t]:
                    h = h * x.go_on[t]
                k = t if keep else 0
                gates, own, out = zr[k], new[k], states[t]
                np.matmul(turn, h, out=at)
                np.add(g[: 2 * w], at[: 2 * w], out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[w:], at[2 * w :], out=own)
                own += g[2 * w :]
                np.exp(own, out=own)
                own += 1
                np.divide(2, own, out=own)
                own -= 1
                np.subtract(h, own, out=out)
                out *= gates[:w]
                out += own
                if keep:
                    an[t] = at[2 * w :]
                h = out
    return states, embedded, (zr[:, :w], zr[:, w:], new, an, clear)


def _rows(states: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The states of some steps and lanes as rows that end with a one."""
    w = states.shape[1]
    out = np.ones((len(ok), w + 1), states.dtype)
    out[:, :w] = states.transpose(0, 2, 1).reshape(-1, w).take(ok, axis=0)
    return out


def _reach(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most that a group of rows of the weights can give; states lie within -1 and 1."""
    return np.maximum.reduceat(np.abs(weight) @ np.ones(weight.shape[1], weight.dtype), first)


#: What exp may be given without the maximum taken off first.
SAFE = 60


@lru_cache(maxsize=1 << 12)
def _ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def _softmax(h: np.ndarray, weight: np.ndarray, at: np.ndarray, wide: bool, room: np.ndarray, scale: float, back: np.ndarray | None = None, grad: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own output and the sum of exp over all, the log of which is to be taken off; ``back`` gets that sum times d(-sum)/d of rows, ``grad`` scale * d(-sum)/d of weights.

    h ends with a column of ones, weight with the bias; ``at`` is where each row's own output lies in the flat table of outputs, which is computed in ``room``.
    """
    flat = room[: len(h) * len(weight)]
    e = flat.reshape(len(h), len(weight))
    np.matmul(h, weight.T, out=e)
    if wide:
        e -= e.max(axis=1, keepdims=True)
    mine = flat[at]
    np.exp(e, out=e)
    s = e @ _ones(len(weight), e.dtype)
    if back is not None:
        flat[at] -= s
        np.matmul(e, weight[:, :-1], out=back)
        np.matmul(e.T, h * (scale / s)[:, None], out=grad)
    return mine, s


def _by_class(model: Model, target: np.ndarray) -> np.ndarray:
    """Order of the targets by class."""
    cls = model.class_of[target]
    return np.argsort(cls.astype(np.int16) if len(model.first) < 1 << 15 else cls, kind="stable")


def _output(model: Model, p: dict, wide: tuple, h: np.ndarray, target: np.ndarray, grads: dict | None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target from its state with a one, both in order of classes; with grads also scale * d(-sum)/dh, and gradients are stored."""
    learn, first, n = grads is not None, model.first, len(h)
    cls = model.class_of[target]
    size = np.diff(first)
    room = np.empty(min(n, ROWS) * max(len(size), int(size.max())), h.dtype)
    own, sums, back, grad = np.zeros((2, n), h.dtype), np.ones((2, n), h.dtype), [None, None], None
    if learn:
        back = np.zeros((2, n, h.shape[1] - 1), h.dtype)
        grads["class_out"], grads["word_out"] = np.zeros_like(p["class_out"]), np.empty_like(p["word_out"])
        grad = np.empty_like(p["class_out"])
    place = np.arange(n) % ROWS
    at = place * len(size) + cls
    for a in range(0, n, ROWS):
        y = a + ROWS
        own[0, a:y], sums[0, a:y] = _softmax(h[a:y], p["class_out"], at[a:y], wide[0][0], room, scale, back[0][a:y] if learn else None, grad)
        if learn:
            grads["class_out"] += grad
    cut = np.searchsorted(cls, np.arange(len(first)))
    at = (np.arange(n) - cut[cls]) % ROWS * size[cls] + target - first[cls]
    for c, (a, z, u, v) in enumerate(zip(cut.tolist(), cut[1:].tolist(), first.tolist(), first[1:].tolist())):
        if a == z or v - u == 1:  # a word that is a class has no other output
            if learn:
                grads["word_out"][u:v] = 0
            continue
        weight = p["word_out"][u:v]
        grad = grads["word_out"][u:v] if learn else None
        for b in range(a, z, ROWS):
            y = min(z, b + ROWS)
            into = grad if b == a or not learn else np.empty_like(grad)
            own[1, b:y], sums[1, b:y] = _softmax(h[b:y], weight, at[b:y], wide[1][c], room, scale, back[1, b:y] if learn else None, into)
            if learn and b > a:
                grad += into
    if learn:
        back *= (scale / sums)[:, :, None]
        back[0] += back[1]
    np.log(sums, out=sums)
    own -= sums
    own[0] += own[1]
    return own[0], back[0]


def _all_wide(model: Model, p: dict) -> tuple[tuple[list[bool], list[bool]], float]:
    """Whether class_out and the classes' rows of word_out could make exp overflow, and the most that any can give."""
    reach = _reach(p["class_out"], np.zeros(1, np.int64)), _reach(p["word_out"], model.first[:-1])
    return tuple((~(r <= SAFE)).tolist() for r in reach), max(float(r.max()) for r in reach)


def gradients(model: Model, p: dict, h: np.ndarray, x: Window, scale: float = 1.0, wide: tuple | None = None) -> tuple[float, dict, np.ndarray]:
    """(-log-likelihood of the window, its gradients times scale with the entering state (width, lanes) fixed, leaving state)."""
    w, g = len(h), {}
    (steps, n), dtype = x.source.shape, h.dtype
    states, embedded, (z_all, r_all, new_all, an_all, clear) = _forward(p, h, x)
    ok = np.flatnonzero(x.valid)
    target = x.target.reshape(-1)[ok]
    order = _by_class(model, target)
    ok = ok[order]
    logp, back = _output(model, p, wide or _all_wide(model, p)[0], _rows(states, ok), target[order], g, scale)
    row = np.full(x.valid.size, len(ok))  # of what isn't valid: one of zeros
    row[ok] = np.arange(len(ok))
    dh_all = np.concatenate((back, np.zeros((1, w), dtype))).take(row, axis=0).reshape(steps, n, w).transpose(0, 2, 1)
    g |= {k: np.zeros_like(p[k]) for k in ("gate_state", "gate_in", "gate_bias")}
    dx_all, dh, ones = np.empty((steps, n, w), dtype), np.zeros_like(h), _ones(n, dtype)
    for s, e in reversed(list(zip(_blocks(steps, n), embedded))):
        z, r, new, k = z_all[s], r_all[s], new_all[s], s.stop - s.start
        before = np.empty((k, w, n), dtype)
        before[0], before[1:] = states[s.start - 1] if s.start else h, states[s.start : s.stop - 1]
        if any(clear[s]):
            before *= x.go_on[s][:, None]
        # what a step's dh is multiplied by for its gates and its new state
        rest, by, own = 1 - z, np.empty((k, 3, w, n), dtype), np.empty((k, w, n), dtype)
        np.subtract(before, new, out=own)
        own *= z
        np.multiply(own, rest, out=by[:, 0])
        np.multiply(new, new, out=own)
        np.subtract(1, own, out=own)
        rest *= own
        np.multiply(rest, r, out=by[:, 2])
        np.subtract(r, 1, out=own)
        own *= dtype.type(0.5)  # the scale of an
        own *= an_all[s]
        np.multiply(by[:, 2], own, out=by[:, 1])
        da, d_all = by.reshape(k, 3 * w, n), np.ascontiguousarray(dh_all[s])
        for t in range(k - 1, -1, -1):
            d = d_all[t]
            d += dh
            by[t] *= d
            np.multiply(d, z[t], out=dh)
            dh += p["gate_state"] @ da[t]
            if clear[s.start + t]:
                dh *= x.go_on[s.start + t]
        turned = da.transpose(0, 2, 1)
        g["gate_state"] += (before @ turned).sum(axis=0)
        np.multiply(d_all, rest, out=by[:, 2])
        g["gate_in"] += (e @ turned).sum(axis=0)
        g["gate_bias"] += (da @ ones).sum(axis=0)
        np.matmul(turned, p["gate_in"].T, out=dx_all[s])
    ids = x.source.reshape(-1)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    g["embed"] = ids[first], np.add.reduceat(dx_all.reshape(-1, w).take(order, axis=0), first, axis=0)
    return -float(logp.sum()), g, states[-1]


def _adagrad(p: np.ndarray, square: np.ndarray, d: np.ndarray, rate: float) -> None:
    """A step in place; d is used up."""
    np.maximum(d, -1, out=d)
    np.minimum(d, 1, out=d)
    own = d * d
    square += own
    np.sqrt(square, out=own)
    d /= own
    d *= f4(rate)
    p -= d


def train(model: Model, lists: Iterator[list[np.ndarray]], rate: float = RATE) -> tuple[dict, int]:
    """(parameters after a pass over the lists, words seen), from the model's parameters."""
    p = {k: v.copy() for k, v in model.params.items()}
    square = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    seen, most, state = 0, 0, np.zeros((p["gate_state"].shape[0], LANES), f4)
    wide, calm = None, 0
    for lanes, x in _refilled(ids for some in lists for ids in some):
        if calm <= 0:
            wide, reach = _all_wide(model, p)
            # no parameter moves by more than the rate in a step, so for some windows none can become wide
            calm = (SAFE - reach) / (1.01 * rate * p["word_out"].shape[1])
        calm -= 1
        words = int(x.valid.sum())
        seen, most = seen + words, max(most, words)
        _, g, state = gradients(model, p, state[:, lanes], x, 64 / most, wide)  # a window of few words counts less
        at, d = g.pop("embed")  # elsewhere gradients are 0 and nothing changes
        own, sums = p["embed"].take(at, axis=0), square["embed"].take(at, axis=0)
        _adagrad(own, sums, d, rate)
        p["embed"][at], square["embed"][at] = own, sums
        for k, d in g.items():
            flat, sums, d = p[k].reshape(-1), square[k].reshape(-1), d.reshape(-1)
            for a in range(0, len(d), BLOCK):
                _adagrad(flat[a : a + BLOCK], sums[a : a + BLOCK], d[a : a + BLOCK], rate)
    return p, seen


def log_likelihoods(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each whole word list with its end mark."""
    p, w = model.params, model.params["gate_state"].shape[0]
    out, state, waiting, many = np.zeros(len(ids)), None, [], 0
    if not len(ids):
        return out
    wide, _ = _all_wide(model, p)

    def add() -> None:
        h, target, doc = map(np.concatenate, zip(*waiting))
        order = _by_class(model, target)
        np.add(out, np.bincount(doc[order], _output(model, p, wide, h.take(order, axis=0), target[order], None)[0], len(ids)), out=out)

    for x in _windows(ids):
        n = x.source.shape[1]
        states, _, _ = _forward(p, np.zeros((w, n), f4) if state is None else state[:, :n], x, keep=False)
        state = states[-1]
        ok = np.flatnonzero(x.valid)
        waiting.append((_rows(states, ok), x.target.reshape(-1)[ok], x.doc.reshape(-1)[ok]))
        many += len(ok)
        if many >= 1 << 15:
            add()
            waiting, many = [], 0
    if waiting:
        add()
    return out


def _unknown(model: Model, words: tc.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words beyond the vocabulary: their places, and of the distinct ones letters, the word of each letter, the distinct word of each place."""
    at = np.flatnonzero(word_ids(model, words.hash) == UNKNOWN)
    inverse = pa.array(words.hash[at]).dictionary_encode().indices.to_numpy()
    first = np.zeros(int(inverse.max()) + 1 if len(inverse) else 0, np.int64)
    first[inverse[::-1]] = np.arange(len(inverse))[::-1]
    return at, *_letters(words, at[first]), inverse


def _spelled(model: Model, words: tc.Words) -> np.ndarray:
    """Natural log of the probability of the spellings in each text."""
    at, keys, owner, inverse = _unknown(model, words)
    each = np.bincount(owner, np.log(model.spelling.probability(keys)), int(owner[-1]) + 1 if len(owner) else 0)
    return np.bincount(np.searchsorted(words.bound, at, side="right") - 1, each[inverse], len(words.bound) - 1)


def _batches(it: Iterator[pa.RecordBatch], model: Model, column: str, spell: bool = False) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray], list[bool], list[float]]]:
    """Batches of documents with their word ids, about BATCH words together; with ``spell`` also log-probabilities of their spellings."""
    held, ids, null, spelled, size = [], [], [], [], 0
    for part, texts in tc.batches(it, column):
        words = tc.Words(texts, spans=spell)
        flat = word_ids(model, words.hash)
        ids += [flat[a:z] for a, z in zip(words.bound.tolist(), words.bound[1:].tolist())]
        null += [t is None for t in texts]
        if spell:
            spelled += _spelled(model, words).tolist()
        held.append(part)
        size += len(flat)
        if size + len(ids) >= BATCH:
            yield held, ids, null, spelled
            held, ids, null, spelled, size = [], [], [], [], 0
    if ids:
        yield held, ids, null, spelled


def _counted(it: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """(key, n) of what keys_of(texts) gives as keys and numbers, added up as far as memory goes."""
    sums, waiting, many = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["key", "n"])
    for _, texts in tc.batches(it):
        waiting.append(keys_of(texts))
        many += len(waiting[-1][0])
        if many > 1 << 20:
            sums = _summed(*map(np.concatenate, zip(sums, *waiting)))
            waiting, many = [], 0
            if len(sums[0]) > 1 << 20:  # hand on what is counted so far; it is added up later
                yield batch()
                sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sums = _summed(*map(np.concatenate, zip(sums, *waiting)))
    yield batch()


def vocabulary(docs: DataFrame, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words that occur sqrt(words of all documents) / share times or more, and twice, most frequent first; how often; all words."""

    def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        w = tc.Words(texts).hash.view(np.int64)
        return w, np.ones(len(w), np.int64)

    counted = docs.select("text").where("text is not null").mapInArrow(lambda it: _counted(it, keys_of), "key long, n long")
    counted = materialize(counted.groupBy("key").agg(F.sum("n").alias("n")), "words")
    words = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.where(F.col("n") >= max(2, math.sqrt(words) / share)).orderBy(F.desc("n"), "key").collect()
    return np.array([r[0] for r in top], np.int64).view(U64), np.array([r[1] for r in top], np.int64), int(words)


def spelling(docs: DataFrame, model: Model) -> Spelling:
    """Letters of the words beyond the model's vocabulary, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Model(model.hashes, model.ids, {}, model.first)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)

        def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            _, keys, owner, inverse = _unknown(m, tc.Words(texts, spans=True))
            return keys, np.bincount(inverse)[owner]

        yield from _counted(it, keys_of)

    counted = docs.select("text").where("text is not null").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    return Spelling(got["key"].to_numpy(), got["n"].to_numpy())


def _averaged(models: DataFrame) -> bytes:
    """Average of rows (block, weight, values) over tasks, as bytes of float32 in order of blocks; empty without rows."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(it, "block"):
            total, weight = 0.0, 0.0
            for w, v in zip(group["weight"].to_pylist(), group["values"]):
                total = total + w * np.frombuffer(v.as_py(), f4).astype(np.float64)
                weight += w
            yield pa.RecordBatch.from_arrays([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([(total / weight).astype(f4).tobytes()], pa.binary())], ["block", "values"])

    done = models.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, values binary")
    return b"".join(r[1] for r in sorted(done.collect()))


def tasks(docs: DataFrame, words: int) -> DataFrame:
    """The documents in tasks of about TASK words, but no fewer tasks than run at a time."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-words // TASK)))


def fit(docs: DataFrame, rounds: int = ROUNDS, share: float = SHARE, width: int = WIDTH, rate: float = RATE) -> Model:
    """Train on all documents; see the module's text."""
    text = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    hashes, many, words = vocabulary(text, share)
    model = fresh(hashes, class_bounds(np.concatenate(([1, words - many.sum()], many))), width=width)
    model.spelling, model.words = spelling(text, model), words
    shapes = [(k, model.params[k].shape) for k in NAMES]
    blocks = -(-sum(int(np.prod(s)) for _, s in shapes) // BLOCK)
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

        def run(it: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            start = pickle.loads(sent.value)
            p, seen = train(start, (ids for _, ids, _, _ in _batches(it, start, "text")), rate / (1 + turn))
            if seen:
                parts = np.array_split(np.concatenate([p[k].reshape(-1) for k in NAMES]), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([float(seen)] * blocks), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "weight", "values"])

        part = tasks(text.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn), words // rounds)
        flat = np.frombuffer(_averaged(part.mapInArrow(run, "block int, weight double, values binary")), f4)
        if len(flat):
            cut = np.cumsum([0, *(int(np.prod(s)) for _, s in shapes)])
            model.params = {k: flat[a:z].reshape(s).copy() for (k, s), a, z in zip(shapes, cut, cut[1:])}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for held, ids, null, spelled in _batches(it, m, "text", True):
            ll = log_likelihoods(m, ids) + np.array(spelled)
            n = np.array([len(x) for x in ids])
            none = np.array(null)
            doc = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            yield pa.RecordBatch.from_arrays([doc, pa.array(n.astype(np.int64), mask=none), pa.array(ll, mask=none), pa.array(np.exp(np.minimum(-ll / (n + 1), 700)), mask=none)], ["doc_id", "n_words", "log_likelihood", "perplexity"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, perplexity double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return score(tasks(docs, model.words), model)
