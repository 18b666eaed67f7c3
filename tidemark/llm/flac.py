"""Media columns: byte payloads as FLAC streams of 8-bit mono samples.

Encoder and decoder work on all frames of a batch at once, one lane a frame: a step of the decoder reads the next
Rice code of every frame, so that nothing loops over samples in Python. The encoder picks for each frame the
cheapest of the fixed predictors of order 0 to 2, a linear predictor of order 4 from the autocorrelation, and plain
samples. Each frame carries its CRC-8 and CRC-16, which the decoder verifies, as it does the stream's MD5; a seek
table gives byte offsets of sample numbers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch, keyed, utf8_groups

UNIT, PAD = 192, b" "
BLOCK = 1152
RATE = 8000
SEEK_EVERY = 1
LPC_ORDER, PRECISION = 4, 10
_TOGETHER = 3 << 20

U64 = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.uint8)


def payload(text: bytes) -> bytes:
    """The text, then spaces up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, PAD)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of one buffer, a byte of each at a time."""
    order = np.argsort(-length, kind="stable")
    s, n, c = start[order], length[order], np.zeros(len(start), np.int64)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    for j, k in enumerate(live):
        x = c[:k]
        c[:k] = ((x & 0xFF) << 8) ^ CRC16[(x >> 8) ^ data[s[:k] + j]]
    out = np.empty_like(c)
    out[order] = c
    return out


def frame_header(number: int, samples: int) -> bytes:
    size = {192: 1, 576: 2, 1152: 3}.get(samples, 7)
    head = bytes([0xFF, 0xF8, size << 4, 0b0000_001_0]) + coded_number(number) + (struct.pack(">H", samples - 1) if size == 7 else b"")
    return head + bytes([crc8(head)])


def coded_number(n: int) -> bytes:
    """The scheme of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    for k in range(1, 7):
        if n < 1 << (5 * k + 6):
            return bytes([(0xFF << (7 - k) & 0xFF) & (0xFF ^ (1 << (6 - k))) | n >> (6 * k)] + [0x80 | n >> (6 * j) & 0x3F for j in range(k - 1, -1, -1)])
    raise ValueError(n)


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (lanes, order) and shifts, by Levinson-Durbin on the autocorrelation."""
    n, m = x.shape
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : m - k]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1)
    a, err = np.zeros((n, LPC_ORDER)), r[:, 0] + 1e-9
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        if i:
            a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = err * (1 - k * k) + 1e-9
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit).astype(np.int64), shift


def _predict(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """Residuals; the first samples stay as they are."""
    total = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        total += coefs[:, j : j + 1].astype(np.int32) * x[:, order - 1 - j : x.shape[1] - 1 - j]
    out = x.copy()
    out[:, order:] -= total >> shift[:, None].astype(np.int32)
    return out


FIXED = {0: [], 1: [1], 2: [2, -1]}


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of equal block size, x (lanes, samples) signed: buffer, start and length of each."""
    n, m = x.shape
    x = x.astype(np.int32)
    lpc, lshift = _lpc(x)
    ways = [(k, np.tile(np.array(c, np.int64), (n, 1)).reshape(n, len(c)), np.zeros(n, np.int64), k) for k, c in FIXED.items()] + [(32 + LPC_ORDER - 1, lpc, lshift, LPC_ORDER)]
    best = np.full(n, 8 * m + 1, np.int64)
    kind, order, rice = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    res = x.copy()
    for code, coefs, shift, o in ways:
        r = _predict(x, coefs, shift, o)
        z = (r[:, o:] << 1) ^ (r[:, o:] >> 31)
        mean = z.sum(axis=1, dtype=np.int64) / (m - o)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 14).astype(np.int64)
        cost = (z >> k[:, None].astype(np.int32)).sum(axis=1, dtype=np.int64) + (m - o) * (1 + k) + 8 * o + 18 + (9 + PRECISION * o if code >= 32 else 0)
        less = cost < best
        best[less], kind[less], order[less], rice[less] = cost[less], code, o, k[less]
        res[less] = r[less]
    heads = [frame_header(int(i), m) for i in numbers]
    head_len = np.array([len(h) for h in heads])
    # Fields before the residuals, as (value, bits) of each lane.
    fields = [(np.where(kind < 0, 1, np.where(kind >= 32, kind, 8 + kind)) << 1, np.full(n, 8))]
    for j in range(LPC_ORDER):
        fields.append((x[:, j] & 0xFF, np.where((kind >= 0) & (order > j), 8, 0)))
    is_lpc = kind >= 32
    fields += [(np.full(n, PRECISION - 1), 4 * is_lpc), (lshift, 5 * is_lpc)]
    fields += [(lpc[:, j] & ((1 << PRECISION) - 1), PRECISION * is_lpc) for j in range(LPC_ORDER)]
    fields.append((rice, np.where(kind < 0, 0, 10)))  # coding method 0, partition order 0, parameter
    # Residuals.
    z = (res << 1) ^ (res >> 31)
    q = z >> rice[:, None].astype(np.int32)
    coded = (np.arange(m)[None, :] >= order[:, None]) & (kind >= 0)[:, None]
    bits = np.where(coded, q + 1 + rice[:, None].astype(np.int32), 0)
    low = np.where(coded, (z & ((1 << rice) - 1)[:, None].astype(np.int32)) | (1 << rice)[:, None].astype(np.int32), 0)
    plain = kind < 0
    bits[plain], low[plain] = 8, x[plain] & 0xFF
    before = sum(b for _, b in fields)
    ends = np.cumsum(bits, axis=1, dtype=np.int64) + before[:, None]
    length = head_len + -(-ends[:, -1] // 8) + 2
    start = np.cumsum(length) - length
    base = (start + head_len) * 8
    at, values = [], []
    end = base.copy()
    for v, b in fields:
        end = end + b
        at.append(end[b > 0])
        values.append(np.asarray(v, np.int64)[b > 0])
    full = bits > 0
    at.append((ends + base[:, None])[full])
    values.append(low[full].astype(np.int64))
    last = np.concatenate(at) - 1
    value = np.concatenate(values) << (7 - (last & 7))
    last >>= 3
    total = int(length.sum())
    out = sum(np.bincount(last - j, (value >> (8 * j)) & 0xFF, total) for j in range(3)).astype(np.uint8)
    where = np.repeat(start - (np.cumsum(head_len) - head_len), head_len) + np.arange(head_len.sum())
    out[where] = np.frombuffer(b"".join(heads), np.uint8)
    c = crc16(out, start, length - 2)
    out[start + length - 2], out[start + length - 1] = c >> 8, c & 0xFF
    return out, start, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams; payloads have a positive multiple of 192 bytes."""
    spans = [(d, i, s, min(BLOCK, len(p) - s)) for d, p in enumerate(payloads) for i, s in enumerate(range(0, len(p), BLOCK))]
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    first = np.cumsum([0] + [len(p) for p in payloads])
    parts: dict[tuple[int, int], bytes] = {}
    for m in {s[3] for s in spans}:
        mine = [s for s in spans if s[3] == m]
        at = np.array([first[d] + s for d, _, s, _ in mine])
        out, start, length = _frames(data[at[:, None] + np.arange(m)], np.array([i for _, i, *_ in mine]))
        out = out.tobytes()
        for (d, i, *_), s, n in zip(mine, start.tolist(), length.tolist()):
            parts[d, i] = out[s : s + n]
    streams = []
    for d, p in enumerate(payloads):
        frames = [parts[d, i] for i in range(-(-len(p) // BLOCK))]
        sizes = list(map(len, frames))
        info = struct.pack(">HH", max(16, min(BLOCK, len(p))), max(16, min(BLOCK, len(p)))) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        offset, table = 0, b""
        for i, n in enumerate(sizes):
            if i % SEEK_EVERY == 0:
                table += struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(p) - i * BLOCK))
            offset += n
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames))
    return streams


class Bits:
    """A cursor for each lane over one buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.at = at.astype(np.int64) * 8

    def peek(self) -> np.ndarray:
        return self.words[self.at >> 3].astype(U64) << (self.at & 7).astype(U64)

    def take(self, bits) -> np.ndarray:
        """So many bits (0 to 32) of each lane."""
        bits = np.broadcast_to(np.asarray(bits, np.int64), self.at.shape)
        out = (self.peek() >> U64(1)) >> (63 - bits).astype(U64)
        self.at = self.at + bits
        return out.astype(np.int64)

    def signed(self, bits) -> np.ndarray:
        v, bits = self.take(bits), np.broadcast_to(np.asarray(bits, np.int64), self.at.shape)
        return np.where((bits > 0) & (v >> np.maximum(bits - 1, 0) & 1 == 1), v - (1 << bits), v)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """The next Rice code of each lane."""
        w = self.peek()
        q = _ZEROS[w >> U64(48)].astype(np.int64)
        if (q == 16).any():
            q = self._long(q)
            self.at += q + 1
            z = q << k | self.take(k)
        else:
            r = ((w << (q + 1).astype(U64)) >> U64(1)) >> (63 - k).astype(U64)
            self.at += q + 1 + k
            z = q << k | r.astype(np.int64)
        return z >> 1 ^ -(z & 1)

    def _long(self, q: np.ndarray) -> np.ndarray:
        q, more = q.copy(), np.flatnonzero(q == 16)
        while len(more):
            at = self.at[more] + q[more]
            w = self.words[at >> 3].astype(U64) << (at & 7).astype(U64)
            z = _ZEROS[w >> U64(48)]
            q[more] += z
            more = more[z == 16]
        return q


class DamagedStream(ValueError):
    """A checksum, a sync code or a size is wrong."""


def _need(good, what: str) -> None:
    if not np.all(good):
        raise DamagedStream(what)


def _decode_frames(data: np.ndarray, start: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of one block size: samples (lanes, n), and the byte after each frame."""
    n = len(start)
    b = Bits(data, start)
    header = b.take(8)
    kind = header >> 1
    is_lpc, is_fixed, plain = kind >= 32, (kind >= 8) & (kind <= 12), kind == 1
    _need((header & 0x81 == 0) & (is_lpc | is_fixed | plain), "subframe")
    order = np.where(is_lpc, kind - 31, np.where(is_fixed, kind - 8, 0))
    top = int(order.max(initial=0))
    out = np.zeros((samples, n), np.int32)
    for j in range(top):
        live = order > j
        out[j] = np.where(live, b.signed(np.where(live, 8, 0)), 0)
    coefs, shift = np.zeros((max(1, top), n), np.int64), np.zeros(n, np.int64)
    if is_lpc.any():
        precision = np.where(is_lpc, b.take(np.where(is_lpc, 4, 0)) + 1, 0)
        shift = b.signed(np.where(is_lpc, 5, 0))
        for j in range(top):
            coefs[j] = b.signed(np.where(is_lpc & (order > j), precision, 0))
    for o, c in {**FIXED, 3: [3, -3, 1], 4: [4, -6, 4, -1]}.items():
        for j, v in enumerate(c if o <= top else []):
            coefs[j, is_fixed & (order == o)] = v
    coded = np.flatnonzero(~plain)
    if len(coded):
        r = Bits(data, np.zeros(len(coded)))
        r.at = b.at[coded]
        _need(r.take(2) == 0, "coding method")
        parts = 1 << r.take(4)
        each, o, k = samples // parts, order[coded], np.zeros(len(coded), np.int64)
        same = (o == o[0]).all() and (parts == 1).all()
        for t in range(samples):
            begins = t == 0 if same else ((t % each == 0) if (parts > 1).any() else np.full(len(coded), t == 0))
            if np.any(begins):
                k = np.where(begins, r.take(np.where(begins, 4, 0)), k)
                _need(k < 15, "escaped partition")
            skip = t < o
            if not skip.any():
                out[t, coded] = r.rice(k)
            elif not skip.all():
                go = np.flatnonzero(~skip)
                part = Bits(data, np.zeros(len(go)))
                part.at = r.at[go]
                out[t, coded[go]] = part.rice(k[go])
                r.at[go] = part.at
        b.at[coded] = r.at
    if plain.any():
        at = np.flatnonzero(plain)
        out[:, at] = data[(b.at[at] >> 3)[None, :] + np.arange(samples)[:, None]].astype(np.int8)
        b.at[at] += 8 * samples
    predicted = np.flatnonzero((order > 0) & ~plain)
    if len(predicted):
        x, o, c, s = np.ascontiguousarray(out[:, predicted]), order[predicted], coefs[:, predicted], shift[predicted]
        c32, s32 = c.astype(np.int32), s.astype(np.int32)
        for t in range(1, samples):
            p = sum(c32[j] * x[t - 1 - j] for j in range(min(t, top)))
            x[t] += np.where(o <= t, p >> s32, 0)
        out[:, predicted] = x
    return out.T, (b.at + 7) >> 3


def decode(streams: list[bytes], start: list[int] | None = None) -> list[bytes]:
    """Payloads of FLAC streams of 8-bit mono; raises DamagedStream where a checksum is wrong.

    Frames are found from the first on: all streams' first frames are decoded together, then all second ones, where
    the seek table gives starting points for many at once. With ``start``, each stream is read from this sample on: by
    its seek table from the last point before it, so that no earlier frame is decoded; the sum over the whole
    stream is then not checked, those of the frames are.
    """
    data = np.frombuffer(b"".join(streams) + b"\0" * 64, np.uint8)
    first = np.cumsum([0] + [len(s) for s in streams])
    cursors, totals, sums, out = [], [], [], []
    for d, s in enumerate(streams):
        _need(s[:4] == b"fLaC", "marker")
        at, done, seek, info = 4, False, [], b""
        while not done:
            kind, size = s[at], int.from_bytes(s[at + 1 : at + 4], "big")
            body = s[at + 4 : at + 4 + size]
            done, at = kind >= 128, at + 4 + size
            if kind & 127 == 0:
                info = body
            elif kind & 127 == 3:
                seek = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        total = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
        totals.append(total)
        sums.append(info[18:34])
        out.append(np.zeros(total, np.int8))
        points = [(n, o) for n, o, _ in seek if n < total] or [(0, 0)]
        if start is not None:
            points = points[max(0, sum(n <= start[d] for n, _ in points) - 1) :]
        cursors += [(d, n, first[d] + at + o, end) for (n, o), end in zip(points, [n for n, _ in points[1:]] + [total])]
    while cursors:
        size: dict[int, list] = {}
        for d, n, at, end in cursors:
            h = data[at : at + 16].tobytes()
            _need(h[0] == 0xFF and h[1] == 0xF8 and h[3] == 2, "frame header")
            extra = 0 if h[4] < 0x80 else 8 - (h[4] ^ 0xFF).bit_length() - 1
            code, to = h[2] >> 4, 5 + extra
            m = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8) if code >= 8 else int.from_bytes(h[to : to + code - 5], "big") + 1
            to += code - 5 if code in (6, 7) else 0
            _need(crc8(h[:to]) == h[to], "CRC-8")
            size.setdefault(m, []).append((d, n, at, end, to + 1))
        cursors = []
        for m, mine in size.items():
            begin = np.array([x[2] for x in mine])
            x, after = _decode_frames(data, begin + np.array([x[4] for x in mine]), m)
            _need(after + 2 <= len(data), "length")
            _need(crc16(data, begin, after - begin) == (data[after].astype(np.int64) << 8 | data[after + 1]), "CRC-16")
            for (d, n, _, end, _), row, at in zip(mine, x.astype(np.int8), after + 2):
                out[d][n : n + m] = row
                if n + m < end:
                    cursors.append((d, n + m, int(at), end))
    if start is not None:
        return [(x[n:].view(np.uint8) ^ 128).tobytes() for x, n in zip(out, start)]
    for x, s in zip(out, sums):
        _need(hashlib.md5(x.tobytes()).digest() == s, "MD5")
    return [(x.view(np.uint8) ^ 128).tobytes() for x in out]


ENCODED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encode(batches):
    for b in batches:
        for i, j, texts in utf8_groups(b.column(1), _TOGETHER):
            yield batch(ENCODED, b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), list(map(len, texts)), encode(list(map(payload, texts))))


def media_column(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, n_bytes, media (a FLAC stream of the padded text).

    Null is the empty text, whose payload is 192 spaces. Texts of any length are stored whole, in frames of BLOCK
    samples; of equally short ways to code a frame the first is taken. Null ids are kept. Equal texts give equal streams. An empty table gives an empty
    result; columns other than the two named are not read.
    """
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_encode, "doc_id long, row long, n_bytes long, media binary")


def blocks(payload: bytes) -> list[tuple[int, bytes]]:
    """(sample offset, samples) of the blocks in which a decoded stream is kept."""
    return [(s, payload[s : s + BLOCK]) for s in range(0, len(payload), BLOCK)]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decoded blocks of a media column: doc_id, row, sample_offset, n_samples, pcm (unsigned 8-bit)."""

    def run(batches):
        for b in batches:
            for i, j, media in utf8_groups(b.column(3), _TOGETHER):
                ids, rows = b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()
                cut = [(d, r, s, len(x), x) for d, r, p in zip(ids, rows, decode(media)) for s, x in blocks(p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "row", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "row", "n_bytes", "media").mapInArrow(run, "doc_id long, row long, sample_offset long, n_samples int, pcm binary")


def feature(parts: list[tuple[int, bytes]]) -> str:
    """Mean, root mean square and zero crossings of the samples around the middle, from blocks in the order of their offsets."""
    n = total = square = crossings = 0
    last = None
    for _, block in sorted(parts):
        x = np.frombuffer(block, np.uint8).astype(np.int64) - 128
        n, total, square, low = n + len(x), total + int(x.sum()), square + int(x @ x), x < 0
        crossings += int((low[1:] != low[:-1]).sum()) + int(last is not None and last != low[0])
        last = low[-1]
    return f"{total / n:.4f}|{np.sqrt(square / n):.4f}|{crossings}"


def digest(parts: list[tuple[int, bytes]]) -> str:
    """SHA-256 of the samples, block by block."""
    h = hashlib.sha256()
    for _, block in sorted(parts):
        h.update(block)
    return h.hexdigest()


READ = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _read(batches):
    for b in batches:
        for i, j, media in utf8_groups(b.column(3), _TOGETHER):
            parts = [blocks(p) for p in decode(media)]
            size = [s + len(x) for s, x in (p[-1] for p in parts)]
            tails = decode(media, [n - 16 for n in size])  # by the seek table: the last frames only
            yield batch(
                READ, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), size, list(map(digest, parts)),
                list(map(zlib.crc32, tails)), list(map(len, media)), [hashlib.sha256(x).hexdigest() for x in media], list(map(feature, parts)),
            )


def op9_flac_media(spark, sf_dir: str) -> DataFrame:
    media = media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.mapInArrow(_read, "doc_id long, row long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").drop("row")
