"""Byte-level BPE encoding by backtracking, and decoding with an offset table.

Encoding.  A text is cut into pieces by the vocabulary's pattern.  An Aho-Corasick automaton
over all tokens, read from the end of a piece to its start, gives the longest token that
begins at every place.  The encoder takes the longest token if the pair with the token before
it is *compatible* (encoding the two together gives just these two) and the place it leads to
isn't known to be a dead end; else it tries the next shorter token, and with none left it
takes back the last token.  Every place is left at most once for each token tried, so the time
is linear, and the result is the one that merging in order of rank gives.

All this runs in numpy for many texts at once: the distinct pieces of a batch go through the
automaton together, a byte of each in a step, and then through the encoder together, a
decision of each in a step; their ids are then gathered for every occurrence.  A piece of more
than ``LONG_PIECE`` bytes takes the same steps alone.  Nothing is kept from batch to batch but
a table of ``2**REMEMBERED`` checked pairs.

Compatibility needs only the table of merges (which two tokens make a token) and its inverse.

Decoding.  The bytes of all tokens lie in one array with an offset for each id, so decoding
is a gather.

Cases.  A null text has null ids, count and round trip; an empty text has no ids.  Rows with
a null doc_id and repeated rows are encoded like others.  Texts of any length are encoded
whole.  Other columns are not read.  Decoding gives null for null ids; ids outside the
vocabulary are an error.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded together (one text at least).
BATCH = 1 << 21
#: Bytes of a piece beyond which it is encoded alone.
LONG_PIECE = 128
#: Bits of the table of checked pairs.
REMEMBERED = 19
U64 = np.uint64


@dataclass
class Vocabulary:
    """Token bytes by id, the merge that makes each token (itself for single bytes), the pattern."""

    blob: bytes
    offset: np.ndarray
    split: np.ndarray
    pattern: str = PATTERN
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"blob": self.blob, "offset": self.offset, "split": self.split, "pattern": self.pattern, "_made": {}}

    def __len__(self) -> int:
        return len(self.offset) - 1

    def token(self, i: int) -> bytes:
        return self.blob[self.offset[i] : self.offset[i + 1]]

    @property
    def encoder(self) -> Encoder:
        if "encoder" not in self._made:  # workers keep the last one from task to task
            key = (self.blob, self.pattern)
            if tc.held.get("key") != key:
                tc.held.update(key=key, encoder=Encoder(self))
            self._made["encoder"] = tc.held["encoder"]
        return self._made["encoder"]


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are merged last when the token is built by merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        best, at = limit, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], limit)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """Read a file of lines "base64 of the token, blank, rank"; ranks are ids without gaps."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    tokens = [t for _, t in pairs]
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return vocabulary(tokens, pattern)


def vocabulary(tokens: list[bytes], pattern: str = PATTERN) -> Vocabulary:
    """A vocabulary from tokens in order of rank; it must hold all single bytes."""
    ranks = {t: i for i, t in enumerate(tokens)}
    split = np.tile(np.arange(len(tokens), dtype=np.int32)[:, None], (1, 2))
    for i, t in enumerate(tokens):
        if len(t) > 1:
            made = _merge_of(t, ranks)
            split[i] = (-1, -1) if made is None else (ranks[made[0]], ranks[made[1]])
    return Vocabulary(b"".join(tokens), np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64), split, pattern)


class _Table:
    """Numbers by 64-bit key, in open addressing; keys are distinct and less than 2**63."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, at, rest = keys.astype(np.int64), self._start(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[rest[free]]  # of several that want a place one gets it
            mine = self.keys[at] == keys[rest]
            self.values[at[mine]] = values[rest[mine]]
            rest, at = rest[~mine], (at[~mine] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at = self._start(keys)
        found = self.keys[at]
        out = self.values[at]  # -1 where the place is empty
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.keys[at[rest]]
            out[rest] = self.values[at[rest]]
            rest = rest[(found != keys[rest]) & (found >= 0)]
        return out


class Automaton:
    """Aho-Corasick over tokens read backwards: after a place's byte, the longest token that begins there."""

    def __init__(self, blob: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray):
        state, many, level = np.zeros(len(ids), np.int64), 1, []
        own = np.full(1, -1, np.int32)
        live = np.arange(len(ids))
        while len(live):
            depth = len(level)
            live = live[size[live] > depth]
            key, inverse = np.unique((state[live] << 8) | blob[start[live] + size[live] - 1 - depth], return_inverse=True)
            state[live] = many + inverse
            level.append((key, many + np.arange(len(key))))
            many += len(key)
            own = np.concatenate((own, np.full(len(key), -1, np.int32)))
            done = live[size[live] == depth + 1]
            own[state[done]] = ids[done]
        self.next = _Table(np.concatenate([k for k, _ in level]), np.concatenate([s for _, s in level]))
        self.fail, self.longest = np.zeros(many, np.int32), own
        for depth, (key, here) in enumerate(level):
            if depth:
                self.fail[here] = self.step(self.fail[key >> 8].astype(np.int64), key & 255)
            none = here[own[here] < 0]
            own[none] = own[self.fail[none]]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after a byte, of many at once."""
        out = self.next.get((state << 8) | byte).astype(np.int64)
        rest = np.flatnonzero(out < 0)
        while len(rest):
            stuck = state[rest] == 0
            out[rest[stuck]] = 0
            rest = rest[~stuck]
            state[rest] = self.fail[state[rest]]
            out[rest] = self.next.get((state[rest] << 8) | byte[rest])
            rest = rest[out[rest] < 0]
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.plain = vocab, vocab.pattern == PATTERN
        self.left, self.right = vocab.split[:, 0].astype(np.int64), vocab.split[:, 1].astype(np.int64)
        self.size = np.diff(vocab.offset)
        usable = np.flatnonzero(self.left >= 0)
        merged = usable[self.left[usable] != usable]
        self.pairs = _Table(self.left[merged] * len(vocab) + self.right[merged], merged)
        self.automaton = Automaton(np.frombuffer(vocab.blob, np.uint8), vocab.offset[:-1], np.where(self.left >= 0, self.size, 0)[usable], usable)
        self.ids = {vocab.token(i): i for i in usable.tolist()}
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = np.array([next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in map(vocab.token, range(len(vocab)))], np.int64)
        self.find = regex.compile(vocab.pattern).findall
        self.checked, self.verdict = np.full(1 << REMEMBERED, -1, np.int64), np.zeros(1 << REMEMBERED, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the bytes of a and b together gives a and b, for many pairs.

        The merges that built both are undone from the border outwards, the latest first; a
        merge across the border that would have come before the one undone rules the pair out.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 60)
        while len(live):
            made = self.pairs.get(a * len(self.vocab) + b)
            bad = (made >= 0) & (made < limit)
            ok[live[bad]] = False
            ra, lb = self.right[a], self.left[b]
            single_a, single_b, late = ra == a, lb == b, a > b
            undo_a = ~single_a & (late | single_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, ra, a), np.where(undo_a, b, lb)
            go = ~bad & ~(single_a & single_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def checks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), looked up where the pair was checked lately."""
        key = a * len(self.vocab) + b
        at = ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - REMEMBERED)).astype(np.int64)
        out = self.verdict[at]
        new = np.flatnonzero(self.checked[at] != key)
        if len(new):
            _, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            new_ok = self.compatible(a[new[first]], b[new[first]])
            out[new] = new_ok[inverse]
            one = new[first]
            self.checked[at[one]] = key[one]
            same = self.checked[at[one]] == key[one]  # two may want one place
            self.verdict[at[one[same]]] = new_ok[same]
        return out

    @property
    def match(self) -> ahocorasick.Automaton:
        """The tokens as an automaton for long pieces, made when the first is met."""
        if not hasattr(self, "_match"):
            self._match = ahocorasick.Automaton()
            for t, i in self.ids.items():
                self._match.add_word(t.decode("latin-1"), i)
            self._match.make_automaton()
        return self._match

    def piece(self, data: bytes) -> list[int]:
        """Ids of one long piece of the pattern."""
        n, size, shorter, table = len(data), self.size, self.shorter, [-1] * len(data)
        for end, t in self.match.iter(data.decode("latin-1")):
            table[end + 1 - size[t]] = t  # a later end at the same start is a longer token
        out: list[int] = []
        good: dict[tuple[int, int], bool] = {}
        dead: set[int] = set()
        at, last, token = 0, -1, table[0]
        while True:
            end = at + int(size[token])
            if end not in dead:
                ok = last < 0 or good.get((last, token))
                if ok is None:
                    ok = good[last, token] = bool(self.compatible(np.array([last]), np.array([token]))[0])
                if ok:
                    out.append(token)
                    if end == n:
                        return out
                    at, last, token = end, token, table[end]
                    continue
            token = int(shorter[token])
            while token < 0:  # a dead end: take the last token back and go on with a shorter one
                dead.add(at)
                token = out.pop()
                at -= int(size[token])
                last = out[-1] if out else -1
                token = int(shorter[token])

    def longest(self, data: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The longest token that begins at each byte of pieces, sorted by falling size, that end at these bytes."""
        out = np.full(len(data), -1, np.int64)
        state = np.zeros(len(end), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            at = end[:live] - 1 - step
            state = self.automaton.step(state[:live], data[at].astype(np.int64))
            out[at] = self.automaton.longest[state]
        return out

    def pieces(self, data: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces that lie one after the other, and where each one's begin."""
        size = np.diff(bound)
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG_PIECE) :]  # those of at most LONG_PIECE bytes
        order = order[size[order] > 0]
        longest = self.longest(data, bound[1:][order], size[order])
        out, count = np.zeros(len(data), np.int32), np.zeros(len(size), np.int64)  # a piece has at most an id a byte
        for k in np.flatnonzero(size > LONG_PIECE).tolist():
            own = self.piece(data[bound[k] : bound[k + 1]].tobytes())
            out[bound[k] : bound[k] + len(own)], count[k] = own, len(own)
        dead = np.zeros(len(data) + 1, bool)
        base, stop = bound[:-1][order], bound[1:][order]
        at, depth, last, token = base.copy(), np.zeros(len(order), np.int64), np.full(len(order), -1), longest[base]
        while len(order):
            end = at + self.size[token]
            ok = ~dead[end] | (end == stop)  # a place is marked for its own piece; the next one begins at the end
            ask = np.flatnonzero(ok & (last >= 0))
            ok[ask] = self.checks(last[ask], token[ask])
            yes = np.flatnonzero(ok)
            out[base[yes] + depth[yes]] = token[yes]
            depth[yes] += 1
            at[yes], last[yes] = end[yes], token[yes]
            over = at == stop
            count[order[over]] = depth[over]
            go = yes[~over[yes]]
            token[go] = longest[at[go]]
            no = np.flatnonzero(~ok)
            token[no] = self.shorter[token[no]]
            no = no[token[no] < 0]
            while len(no):  # dead ends: take the last token back and go on with a shorter one
                dead[at[no]] = True
                depth[no] -= 1
                back = out[base[no] + depth[no]].astype(np.int64)
                at[no] -= self.size[back]
                last[no] = np.where(depth[no] > 0, out[base[no] + np.maximum(depth[no] - 1, 0)], -1)
                token[no] = self.shorter[back]
                no = no[token[no] < 0]
            if over.any():
                go = ~over
                order, base, stop, at, depth, last, token = (x[go] for x in (order, base, stop, at, depth, last, token))
        first = np.concatenate(([0], np.cumsum(count)))
        take = np.repeat(bound[:-1] - first[:-1], count) + np.arange(first[-1])
        return out[take], first

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bytes of all texts, where their pieces begin with the end, the first piece of each text with the number of pieces)."""
        if self.plain:
            return _cut(texts)
        found = [self.find(t) for t in texts]
        if any(sum(map(len, some)) != len(t) for some, t in zip(found, texts)):
            raise ValueError("the pattern leaves out characters")
        chunks = [p.encode() for some in found for p in some]
        return b"".join(chunks), np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """(ids of all texts, where each one's begin, the texts' bytes, where each one's begin)."""
        raw, begin, first = self.cut(texts)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        which, kinds = pieces.indices.to_numpy(), pieces.dictionary
        bound = np.frombuffer(kinds.buffers()[1], np.int32)[: len(kinds) + 1].astype(np.int64) if len(kinds) else np.zeros(1, np.int64)
        ids, at = self.pieces(np.frombuffer(kinds.buffers()[2] or b"", np.uint8)[: bound[-1]], bound)
        count = np.diff(at)[which]
        total = np.concatenate(([0], np.cumsum(count)))
        take = np.repeat(at[which] - total[:-1], count) + np.arange(total[-1])
        return ids[take], total[first], raw, begin[first]


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is to the pattern."""
    out = np.full(0x110000, _OTHER, np.uint8)
    code = np.arange(0x110000, dtype="<u4")
    everything = code[(code < 0xD800) | (code >= 0xE000)].tobytes().decode("utf-32-le")
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        out[tc.points("".join(regex.findall(pattern, everything)))] = kind
    return out


def _cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The pieces of PATTERN, for all texts at once.

    Runs of letters, of numbers and of other solid characters are pieces, with a blank before
    them if there is one.  White space before that is a piece, and so is a last character of
    white space that isn't a blank.  An apostrophe alone, without a blank, takes s, t, re, ve,
    m, ll or d from the letters after it, and the rest of these letters is a piece.
    """
    joined = "".join(texts)
    code = tc.points(joined)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.concatenate(([0], np.cumsum(size)))
    n = len(code)
    kind = _kinds()[code]
    start = np.ones(n + 1, bool)  # where runs begin, and the end
    if n:
        start[1:n] = kind[1:] != kind[:-1]
    start[edge] = True
    run = np.flatnonzero(start)
    own = kind[run[:-1]]
    space = np.flatnonzero(own == _SPACE)
    if len(space):
        last = np.zeros(n + 1, bool)
        last[edge] = True
        z = run[space + 1]
        inner = ~last[z]  # white space before something solid
        z, a = z[inner], run[space[inner]]
        blank = code[z - 1] == 32
        start[z[blank]] = False
        start[z - 1] = True  # its last character goes with what follows, or alone
    mark = np.flatnonzero((own == _OTHER) & (np.diff(run) == 1))
    mark = run[mark[code[run[mark]] == 39]]
    mark = mark[start[mark] & (mark + 1 < n)]
    if len(mark):
        mark = mark[start[mark + 1] & (kind[mark + 1] == _LETTER) & ~np.isin(mark + 1, edge)]
        two = np.minimum(mark + 2, n - 1)
        pair = np.where((mark + 2 < n) & ~np.isin(mark + 2, edge), code[two], 0)
        c = code[mark + 1]
        long = ((c == 114) | (c == 118)) & (pair == 101) | (c == 108) & (pair == 108)
        short = np.isin(c, [115, 116, 109, 100])
        take = mark[short | long]
        start[take + 1] = False
        start[take + np.where(long[short | long], 3, 2)] = True
    width = 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)
    byte = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    begin = np.flatnonzero(start)
    return joined.encode(), byte[begin], np.searchsorted(begin, edge)


def decode_ids(vocab: Vocabulary, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of many id lists at once, and where each list's begin."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocab)):
        raise ValueError("an id lies outside the vocabulary")
    size = vocab.offset[ids + 1] - vocab.offset[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(vocab.offset[ids] - total[:-1], size) + np.arange(total[-1])
    return np.frombuffer(vocab.blob, np.uint8)[take], total[bound]


def encode_batch(vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin; a null text has none."""
    return vocab.encoder.encode([t or "" for t in texts])[:2]


def list_array(ids: np.ndarray, bound: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Arrow list<int> from flat ids; entries that are null are empty in bound."""
    offsets = pa.array(bound.astype(np.int32), mask=None if null is None else np.concatenate((null, [False])))
    return pa.ListArray.from_arrays(offsets, pa.array(ids))


def token_lists(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, token_ids) of each document, without decoding them again."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it, "text", keep=True, limit=BATCH):
            ids, bound = encode_batch(sent.value, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(ids, bound, np.array([t is None for t in texts]))], ["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")


def encode(docs: DataFrame, vocab: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep, n_tokens, token_ids, round_trip) of each document; round_trip: decoding gave the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["doc_id", *keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tc.batches(it, "text", keep=True, limit=BATCH):
            v = sent.value
            ids, bound, own, edge = v.encoder.encode([t or "" for t in texts])
            raw, cut = decode_ids(v, ids, bound)
            null = np.array([t is None for t in texts])
            same = np.diff(cut) == np.diff(edge)
            if same.all():
                same = np.diff(np.concatenate(([0], np.cumsum(raw != np.frombuffer(own, np.uint8))))[edge]) == 0
            else:
                same &= np.array([raw[a:z].tobytes() == own[x:y] for a, z, x, y in zip(cut.tolist(), cut[1:].tolist(), edge.tolist(), edge[1:].tolist())])
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(names))] + [pa.array(np.diff(bound).astype(np.int32), mask=null), list_array(ids, bound, null), pa.array(same, mask=null)],
                [*names, "n_tokens", "token_ids", "round_trip"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids)."""
    sent = tokens.sparkSession.sparkContext.broadcast(vocab)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            lists = part.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            bound = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            raw, cut = decode_ids(sent.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bound)
            raw, null = raw.tobytes(), lists.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if n else raw[a:z].decode("utf-8", "replace") for n, a, z in zip(null, cut.tolist(), cut[1:].tolist())], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), load())
