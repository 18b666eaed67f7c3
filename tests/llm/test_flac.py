import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import flac as P


def slow_decode(s: bytes) -> bytes:
    """Bit by bit, frame by frame, from the format's description."""
    info = s[8:42]
    total = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
    at = 42
    last = False
    while not last:
        last, at = s[at] >= 128, at + 4 + int.from_bytes(s[at + 1 : at + 4], "big")
    bits, at, out = "".join(f"{b:08b}" for b in s), at * 8, []

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    while len(out) < total:
        begin = at // 8
        assert take(16) == 0xFFF8
        code = take(4)
        assert take(4) == 0 and take(8) == 2
        lead = take(8)
        at += 0 if lead < 0x80 else 8 * (f"{lead:08b}".index("0") - 1)
        n = {1: 192, 2: 576, 3: 1152}[code] if code < 7 else take(16) + 1
        assert P.crc8(s[begin : at // 8]) == take(8)
        kind = take(8) >> 1
        if kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            o = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(o)]
            c, shift = {0: [], 1: [1], 2: [2, -1]}.get(o, []), 0
            if kind >= 32:
                p = take(4) + 1
                shift = signed(5)
                c = [signed(p) for _ in range(o)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            for _ in range(o, n):
                q = bits.index("1", at) - at
                at += q + 1
                z = q << k | (take(k) if k else 0)
                x.append((z >> 1 ^ -(z & 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        out += x
        at = -(-at // 8) * 8
        crc = 0
        for b in s[begin : at // 8]:
            crc = (crc & 0xFF) << 8 ^ int(P.CRC16[crc >> 8 ^ b])
        assert take(16) == crc
    return bytes(v + 128 for v in out)


def texts():
    rng = random.Random(1)
    return [b"", b"abc", b"x" * 5000, bytes(rng.randrange(256) for _ in range(3000)), "é ö the quick ".encode() * 300, b"\0" * 1153, b"\xff\0" * 900, bytes(range(256)) * 5]


def test_round_trip_and_slow_decoder():
    p = [P.payload(t) for t in texts()]
    streams = P.encode(p)
    assert P.decode(streams) == p
    assert [slow_decode(s) for s in streams] == p
    assert P.encode(p[::-1])[::-1] == streams


@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_any_bytes(values):
    p = [P.payload(v) for v in values]
    assert P.decode(P.encode(p)) == p


@given(st.binary(min_size=1, max_size=20_000), st.lists(st.floats(0, 1), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_seek(value, at):
    p = P.payload(value)
    stream = P.encode([p])[0]
    starts = [int(a * (len(p) - 1)) for a in at]
    assert P.decode([stream] * len(at), starts) == [p[n:] for n in starts]


def test_seek_reads_no_earlier_frame():
    """Damage before the point that the seek table gives does not matter to what is read behind it."""
    p = P.payload(bytes(range(200)) * 400)
    s = P.encode([p])[0]
    bad = bytearray(s)
    bad[len(s) // 8] ^= 255
    assert P.decode([bytes(bad)], [len(p) - 16]) == [p[-16:]]
    try:
        P.decode([bytes(bad)])
    except (P.DamagedStream, IndexError):
        return
    raise AssertionError("damage was not found")


def test_features_from_blocks():
    for t in texts():
        p = P.payload(t)
        x = np.frombuffer(p, np.uint8).astype(np.int64) - 128
        assert P.feature(P.blocks(p)[::-1]) == f"{x.sum() / len(x):.4f}|{np.sqrt((x * x).sum() / len(x)):.4f}|{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
        assert P.digest(P.blocks(p)[::-1]) == hashlib.sha256(p).hexdigest()


def test_damage_is_found():
    s = bytearray(P.encode([P.payload(b"some text to keep " * 200)])[0])
    rng = random.Random(4)
    for _ in range(60):
        i = rng.randrange(8 + 34, len(s))
        bad = bytearray(s)
        bad[i] ^= 1 << rng.randrange(8)
        try:
            same = P.decode([bytes(bad)]) == P.decode([bytes(s)])
        except (P.DamagedStream, IndexError):
            continue
        assert same  # the bit is in a field that decoding does not need


def test_frame_numbers():
    assert all(P.coded_number(n) == chr(n).encode() for n in (0, 127, 128, 2047, 2048, 65535, 65536, 0x10FFFF))
    assert P.coded_number((1 << 31) - 1)[0] == 0xFD


def test_media_column(corpus_df, corpus, empty_df):
    media = P.media_column(corpus_df)
    got = media.mapInArrow(P._read, "doc_id long, row long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    want = Counter((i, len((t or "").encode()), hashlib.sha256(P.payload((t or "").encode())).hexdigest(), zlib.crc32(P.payload((t or "").encode())[-16:])) for i, t in corpus)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by.values())
    blocks = P.pcm_blocks(media).collect()
    parts = {}
    for b in sorted(blocks, key=lambda b: b.sample_offset):
        assert len(parts.get(b.row, b"")) == b.sample_offset and len(b.pcm) == b.n_samples
        parts[b.row] = parts.get(b.row, b"") + bytes(b.pcm)
    assert Counter(parts.values()) == Counter(P.payload((t or "").encode()) for _, t in corpus)
    assert P.media_column(empty_df).count() == 0
