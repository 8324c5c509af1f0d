"""Media columns: AVI files of motion JPEG, decoded and cut into shots.

``clips`` parses the RIFF structure of each file (header, stream format, the ``idx1`` index,
or the ``movi`` list where there is no index, and the lists of further ``AVIX`` segments of
large files), decodes every frame of the first motion-JPEG stream (baseline JPEG: Huffman
decoding, dequantisation, inverse cosine transform) to luma, and compares histograms of
``BINS`` levels of consecutive frames.  Chroma is read to keep the place, but not rebuilt.

The threshold adapts to the film: a frame begins a new shot if its difference (half the L1
distance, 0 to 1) exceeds the median of the differences of up to ``RADIUS`` frames on either
side, without its own, by more than ``FLOOR`` and by more than ``SIGMAS`` robust deviations
(1.4826 times their median absolute deviation).  So flicker raises the bar, cuts nearby don't.

Rows: media_id, clip (from 0), first_frame, last_frame, start_s and end_s (times from the
file's frame duration).  All frames of a file lie in exactly one clip.

Cases.  A null, empty or damaged file, or one without frames, gives one row with clip, frames and
times null and the reason in ``error`` (null otherwise); one damaged frame repeats the picture
before it, as players do (the first, if damaged, is black).  Empty chunks repeat it, too.
Rows with a null media_id and repeated rows are cut like others; other columns are not read.
An empty table gives an empty result.

The test tables hold no media, so ``encode_avi`` writes such files from pictures, and the
query makes one file of each row of embeddings: ``FRAMES_PER_SCENE`` frames for each scene,
2 to 4 scenes by vec_id, each of a brightness far from its neighbours', with the vector's
numbers as its texture and, in each frame, noise of its own somewhere.  Films of odd vec_id flicker:
differences within their scenes exceed ``FLOOR``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BINS = 32
FLOOR = 0.25
SIGMAS = 3.0
RADIUS = 4
FRAME_MICROS = 40_000
FRAMES_PER_SCENE = 4

ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda x: x[0] if s % 2 else -x[0])])
_K = np.arange(8)
_DCT = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)

#: Code counts by length and symbols of the Huffman tables that motion JPEG may leave out (ITU T.81, Annex K).
_DC = {
    0: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    1: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
}
_AC = {
    0: (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    ),
    1: (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
    ),
}


class Damaged(ValueError):
    """A file or frame that can't be read."""


# ---------------------------------------------------------------- JPEG


@lru_cache(maxsize=64)
def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) for each 16-bit prefix; length 0 where no code fits."""
    out: list[tuple[int, int]] = [(0, 0)] * 65536
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            at = code << (16 - length)
            if k >= len(symbols) or at + (1 << (16 - length)) > 65536:
                raise Damaged("Huffman table")
            out[at : at + (1 << (16 - length))] = [(symbols[k], length)] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.size = len(data) * 8
        self.data = data + b"\xff" * 16
        self.at = 0

    def peek16(self) -> int:
        i = self.at >> 3
        d = self.data
        return (((d[i] << 16) | (d[i + 1] << 8) | d[i + 2]) >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek16() >> (16 - n)
        self.at += n
        return v


def _block(bits: _Bits, dc: list, ac: list, out: list, base: int) -> int:
    """Decode one block into out[base:base+64] in zigzag order; the DC difference is returned."""
    size = bits.size
    symbol, n = dc[bits.peek16()]
    if not n or symbol > 15:
        raise Damaged("DC code")
    bits.at += n
    v = bits.take(symbol)
    diff = v if not symbol or v >> (symbol - 1) else v - (1 << symbol) + 1
    k = 1
    while k < 64:
        symbol, n = ac[bits.peek16()]
        if not n or bits.at > size:
            raise Damaged("AC code")
        bits.at += n
        run, s = symbol >> 4, symbol & 15
        if not s:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise Damaged("coefficient")
        v = bits.take(s)
        out[base + k] = v if v >> (s - 1) else v - (1 << s) + 1
        k += 1
    return diff


def decode_luma(jpeg: bytes) -> np.ndarray:
    """Luma (the first component) of a baseline JPEG picture, uint8 (height, width)."""
    if jpeg[:2] != b"\xff\xd8":
        raise Damaged("no JPEG")
    quant: dict[int, np.ndarray] = {}
    dc, ac = {k: _codes(*v) for k, v in _DC.items()}, {k: _codes(*v) for k, v in _AC.items()}
    at, frame, restart = 2, None, 0
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise Damaged("marker")
        mark = jpeg[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body = jpeg[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise Damaged("segment")
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(bytes(counts), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not height or not width or len(body) < 6 + 3 * parts:
                raise Damaged("frame header")
            frame = (height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)])
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise Damaged("not a baseline picture")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            if frame is None:
                raise Damaged("scan before frame")
            return _scan(jpeg[at:], body, frame, restart, quant, dc, ac)
    raise Damaged("no scan")


def _scan(data: bytes, head: bytes, frame: tuple, restart: int, quant: dict, dc: dict, ac: dict) -> np.ndarray:
    height, width, parts = frame
    chosen = {head[1 + 2 * i]: (head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(head[0])}
    if set(chosen) != {c for c, *_ in parts}:
        raise Damaged("more than one scan")
    hmax, vmax = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    if len(parts) == 1:
        hmax = vmax = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    first, hs, vs, table = parts[0]
    if table not in quant:
        raise Damaged("no quantisation table")
    # segments end at restart markers; stuffed zero bytes are dropped
    segments, begin, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        if data[i + 1] == 0:
            i += 2
        elif 0xD0 <= data[i + 1] <= 0xD7:
            segments.append(data[begin:i])
            begin = i = i + 2
        elif data[i + 1] == 0xFF:
            i += 1
        else:
            break
    segments.append(data[begin : i if i >= 0 else len(data)])
    units = across * down
    luma = [0] * (64 * units * hs * vs)
    place, unit, each = 0, 0, restart or units
    plan = [(c == first, dc[chosen[c][0]], ac[chosen[c][1]], h * v, k) for k, (c, h, v, _) in enumerate(parts)]
    waste = [0] * 64
    for segment in segments:
        bits, before = _Bits(segment.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for _ in range(min(each, units - unit)):
            for own, d, a, n, k in plan:
                for _ in range(n):
                    if own:
                        before[k] += _block(bits, d, a, luma, place)
                        luma[place] = before[k]
                        place += 64
                    else:
                        _block(bits, d, a, waste, 0)
            unit += 1
        if unit >= units:
            break
    if unit < units:
        raise Damaged("picture ends early")
    zig = np.array(luma, np.int64).reshape(-1, 64) * quant[table]
    flat = np.zeros_like(zig)
    flat[:, ZIGZAG] = zig
    blocks = np.rint(_DCT.T @ flat.reshape(-1, 8, 8) @ _DCT) + 128
    picture = blocks.reshape(down, across, vs, hs, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * vs * 8, across * hs * 8)
    high, wide = -(-height * vs // vmax), -(-width * hs // hmax)
    return np.clip(picture[:high, :wide], 0, 255).astype(np.uint8)


_QUANT = np.full(64, 8, np.int64)


@lru_cache(maxsize=4)
def _writer(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def encode_luma(picture: np.ndarray, tables: bool = False) -> bytes:
    """Baseline JPEG of a grey picture; the standard Huffman tables are written only on demand."""
    height, width = picture.shape
    down, across = -(-height // 8), -(-width // 8)
    padded = np.pad(picture, ((0, down * 8 - height), (0, across * 8 - width)), mode="edge").astype(np.float64) - 128
    blocks = padded.reshape(down, 8, across, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    zig = np.rint((_DCT @ blocks @ _DCT.T).reshape(-1, 64)[:, ZIGZAG] / _QUANT).astype(int)
    dc, ac = _writer(*_DC[0]), _writer(*_AC[0])
    value, size, before = 0, 0, 0

    def put(code: int, n: int) -> None:
        nonlocal value, size
        value, size = (value << n) | code, size + n

    for row in zig.tolist():
        diff, before = row[0] - before, row[0]
        n = abs(diff).bit_length()
        put(*dc[n])
        put(diff if diff >= 0 else diff + (1 << n) - 1, n)
        run = 0
        last = max((k for k in range(1, 64) if row[k]), default=0)
        for k in range(1, last + 1):
            v = row[k]
            if not v:
                run += 1
                continue
            while run > 15:
                put(*ac[0xF0])
                run -= 16
            n = abs(v).bit_length()
            put(*ac[(run << 4) | n])
            put(v if v >= 0 else v + (1 << n) - 1, n)
            run = 0
        if last < 63:
            put(*ac[0])
    pad = -size % 8
    data = (((value << pad) | ((1 << pad) - 1)).to_bytes((size + pad) // 8, "big")).replace(b"\xff", b"\xff\x00")
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    huffman = b"".join(segment(0xC4, bytes([kind << 4]) + counts + symbols) for kind, (counts, symbols) in ((0, _DC[0]), (1, _AC[0]))) if tables else b""
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes(_QUANT.astype(np.uint8))) + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + huffman + segment(0xDA, b"\1\1\0\0\x3f\0") + data + b"\xff\xd9"


# ---------------------------------------------------------------- AVI


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(frames: list[bytes], width: int, height: int, micros: int = FRAME_MICROS, index: bool = True) -> bytes:
    """AVI file with one motion-JPEG stream."""
    listed = lambda kind, body: _chunk(b"LIST", kind + body)
    head = _chunk(b"avih", struct.pack("<14I", micros, 0, 0, 0x10 if index else 0, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0))
    stream = _chunk(b"strh", b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, micros, 1_000_000, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height))
    form = _chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0))
    movie, entries = b"", b""
    for f in frames:
        entries += b"00dc" + struct.pack("<III", 0x10, 4 + len(movie), len(f))
        movie += _chunk(b"00dc", f)
    body = listed(b"hdrl", head + listed(b"strl", stream + form)) + listed(b"movi", movie)
    return _chunk(b"RIFF", b"AVI " + body + (_chunk(b"idx1", entries) if index else b""))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end of the body) of the chunks in data[at:end]; a cut-off last one is clipped."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(seconds a frame, frames of the first motion-JPEG stream) of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Damaged("no AVI file")
    seconds, stream, number, movie, entries, further = 0.0, None, -1, None, None, []
    for name, a, z in _chunks(data, 12, len(data)):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            for name, b, y in _chunks(data, a + 4, z):
                if name == b"avih" and y - b >= 4:
                    seconds = struct.unpack("<I", data[b : b + 4])[0] / 1e6
                elif name == b"LIST" and data[b : b + 4] == b"strl":
                    number += 1
                    parts = {n: data[c:x] for n, c, x in _chunks(data, b + 4, y)}
                    strh, strf = parts.get(b"strh", b""), parts.get(b"strf", b"")
                    if stream is None and strh[:4] == b"vids" and b"MJPG" in (strh[4:8].upper(), strf[16:20].upper()):
                        stream = number
                        scale, rate = struct.unpack("<II", strh[20:28]) if len(strh) >= 28 else (0, 0)
                        seconds = scale / rate if scale and rate else seconds
        elif name == b"LIST" and kind == b"movi" and movie is None:
            movie = (a, z)
        elif name == b"idx1" and not further:
            entries = (a, z)
        elif name == b"RIFF" and kind == b"AVIX":
            further += [(b, y) for name, b, y in _chunks(data, a + 4, z) if name == b"LIST" and data[b : b + 4] == b"movi"]
    if stream is None or movie is None:
        raise Damaged("no motion-JPEG stream")
    names = (b"%02ddc" % stream, b"%02ddb" % stream)
    frames: list[bytes] = []
    if entries is not None and entries[1] - entries[0] >= 16:
        raw = data[entries[0] : entries[1]]
        rows = [(raw[i : i + 4], *struct.unpack("<III", raw[i + 4 : i + 16])) for i in range(0, len(raw) - 15, 16)]
        rows = [(o, n) for name, _, o, n in rows if name in names]
        # offsets count from the list's kind or from the file's beginning
        base = next((b for o, _ in rows for b in (movie[0], 0) if data[b + o : b + o + 4] in names), None)
        if base is not None:
            frames = [data[base + o + 8 : base + o + 8 + n] for o, n in rows]

    def walk(a: int, z: int) -> None:
        for name, b, y in _chunks(data, a, z):
            if name == b"LIST":
                walk(b + 4, y)
            elif name in names:
                frames.append(data[b:y])

    if not frames:
        walk(movie[0] + 4, movie[1])
    for a, z in further:
        walk(a + 4, z)
    if not frames:
        raise Damaged("no frames")
    return seconds, frames


# ---------------------------------------------------------------- shots


def histogram(picture: np.ndarray, bins: int = BINS) -> np.ndarray:
    return np.bincount((picture.reshape(-1).astype(np.int64) * bins) >> 8, minlength=bins) / max(1, picture.size)


def cuts(hists: np.ndarray, floor: float = FLOOR, sigmas: float = SIGMAS, radius: int = RADIUS) -> list[int]:
    """Frames that begin a shot, 0 among them."""
    diff = np.abs(np.diff(hists, axis=0)).sum(axis=1) / 2
    out = [0]
    for i, d in enumerate(diff.tolist()):
        around = np.sort(np.concatenate((diff[max(0, i - radius) : i], diff[i + 1 : i + 1 + radius])))
        middle = _median(around)
        if d > middle + max(floor, sigmas * 1.4826 * _median(np.sort(np.abs(around - middle)))):
            out.append(i + 1)
    return out


def _median(values: np.ndarray) -> float:
    """Of sorted values; 0 of none."""
    n = len(values)
    return float(values[n // 2] + values[(n - 1) // 2]) / 2 if n else 0.0


def shots(data: bytes) -> list[tuple[int, int, float, float]]:
    """(first frame, last frame, begin, end in seconds) of each shot of a file."""
    seconds, frames = parse_avi(data)
    hists, last = [], None
    for f in frames:
        if last is None or f:
            try:
                last = histogram(decode_luma(f))
            except (Damaged, IndexError, KeyError, struct.error, ValueError):
                last = last if last is not None else np.eye(1, BINS)[0]
        hists.append(last)
    begin = cuts(np.array(hists))
    return [(a, z - 1, a * seconds, z * seconds) for a, z in zip(begin, [*begin[1:], len(frames)])]


def clips(media: DataFrame) -> DataFrame:
    """(media_id, clip, first_frame, last_frame, start_s, end_s, error) from (media_id, media)."""
    schema = "media_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, error string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                rows = []
                for media_id, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        rows += [(media_id, k, a, z, round(s, 6), round(e, 6), None) for k, (a, z, s, e) in enumerate(shots(data or b""))]
                    except (Damaged, struct.error, IndexError) as why:
                        rows.append((media_id, None, None, None, None, None, str(why) or "damaged"))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, schema)


def scenes(vec_id: int) -> int:
    return 2 + vec_id % 3


def picture(vec_id: int, vector: list[float], scene: int, frame: int) -> np.ndarray:
    """32 by 32 points: a brightness of its own for each scene, a ramp with the vector as texture, and the frame's noise and flicker."""
    level = (44, 204, 92, 236)[scene] + (2 * (frame % 2) if vec_id % 2 else 0)
    v = np.resize(np.nan_to_num(np.asarray(vector or [0.0], np.float64), nan=0, posinf=0, neginf=0), 16)
    ramp = np.arange(16) % 8 - 3.5
    out = level + np.kron((ramp + np.tanh(np.roll(v, scene)) / 2).reshape(4, 4), np.ones((8, 8)))
    g = np.random.default_rng((abs(vec_id), scene, frame))
    y, x = 8 * g.integers(0, 4, 2)
    out[y : y + 8, x : x + 8] += g.choice((-6, 6), (8, 8))  # noise that outlives quantisation
    return np.clip(out, 0, 255).astype(np.uint8)


def synthesize(embeddings: DataFrame) -> DataFrame:
    """(media_id, media): a film for each row of (vec_id, embedding)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                files = []
                for vec_id, vector in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    files.append(encode_avi([encode_luma(picture(vec_id, vector, k, f)) for k in range(scenes(vec_id)) for f in range(FRAMES_PER_SCENE)], 32, 32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["media_id", "media"])

    return embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("media_id"), "embedding").mapInArrow(run, "media_id long, media binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(synthesize(table(spark, sf_dir, "embeddings")))


SQL = f"""
SELECT vec_id AS media_id, clip, clip * {FRAMES_PER_SCENE} AS first_frame, clip * {FRAMES_PER_SCENE} + {FRAMES_PER_SCENE - 1} AS last_frame,
  CAST(clip * {FRAMES_PER_SCENE * FRAME_MICROS} AS DOUBLE) / 1000000 AS start_s, CAST((clip + 1) * {FRAMES_PER_SCENE * FRAME_MICROS} AS DOUBLE) / 1000000 AS end_s, CAST(NULL AS VARCHAR) AS error
FROM (SELECT vec_id, CAST(unnest(range(0, 2 + vec_id % 3)) AS INTEGER) AS clip FROM embeddings)
"""
