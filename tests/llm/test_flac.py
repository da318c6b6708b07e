"""Streams are read back by a plain bit-by-bit decoder, written from the format's description."""

import hashlib
import zlib

import numpy as np
import pytest

from ticksmith.llm import flac, queries

from .common import no_documents, odd_documents, prose


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return v

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def slow_crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def slow_decode(stream):
    assert stream[:4] == b"fLaC"
    at, last, md5, total = 4, False, b"", 0
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            b = Bits(body)
            b.take(16 + 16 + 24 + 24)
            assert b.take(20) == flac.RATE and b.take(3) == 0 and b.take(5) == 7
            total, md5 = b.take(36), body[18:]
        at += 4 + size
    out, number = [], 0
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.take(14) == 0x3FFE and b.take(2) == 0
        size, rate, channels, width, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
        assert (rate, channels, width) == (0, 0, 1)
        lead = b.take(8)
        n, more = lead, 0
        if lead >= 0x80:
            more = f"{lead:08b}".index("0") - 1
            n = lead & ((1 << (6 - more)) - 1)
            for _ in range(more):
                n = n << 6 | b.take(8) & 63
        assert n == number
        count = {10: 1024}.get(size) or b.take(16) + 1
        head = b.at // 8
        assert b.take(8) == slow_crc(stream[at : at + head], 0x07, 8)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        order = kind - 8 if kind < 32 else kind - 31
        x = [b.signed(8) for _ in range(order)]
        weights, shift = flac.FIXED[order] if kind < 32 else None, 0
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        assert b.take(2) == 0 and b.take(4) == 0
        k = b.take(4)
        while len(x) < count:
            q = 0
            while not b.take(1):
                q += 1
            u = q << k | b.take(k)
            e = u >> 1 if u & 1 == 0 else -(u >> 1) - 1
            x.append(e + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
        b.at = (b.at + 7) // 8 * 8
        end = b.at // 8
        assert b.take(16) == slow_crc(stream[at : at + end], 0x8005, 16)
        out += x
        at += end + 2
        number += 1
    assert len(out) == total and hashlib.md5(np.array(out, np.int8).tobytes()).digest() == md5
    return out


PAYLOADS = [flac.padded(t)[1] for t in (None, "a", prose(1, 30), prose(2, 800), "x" * 1024, "\x00" * 3000, "é" * 700)] + [bytes(range(256)) * 6, np.random.default_rng(3).bytes(64 * 40)]


@pytest.mark.parametrize("table,order", [("text", 0), ("linear", 0), ("linear", 6), ("text", 3)])
def test_streams_against_a_plain_decoder(table, order):
    streams = flac.encode(PAYLOADS, table, order)
    back = np.zeros(256, np.uint8)
    back[flac.sample_table(table) + 128] = np.arange(256)
    for s, p, (got, blocks) in zip(streams, PAYLOADS, flac.decode(streams), strict=True):
        assert got == p and back[np.array(slow_decode(s)) + 128].tobytes() == p
        at = 0
        for offset, n, byte in blocks:
            assert offset == at and s[byte : byte + 2] == b"\xff\xf8"
            at += n
        assert at == len(p)
    assert flac.encode(PAYLOADS[2:3], table, order) == streams[2:3]


def test_linear_prediction_shrinks_a_tone():
    tone = (128 + 100 * np.sin(np.arange(64 * 200) / 9)).astype(np.uint8).tobytes()
    plain, linear = flac.encode([tone], "linear")[0], flac.encode([tone], "linear", 8)[0]
    assert len(linear) < len(plain) < len(tone) and flac.decode([linear])[0][0] == tone


def test_every_damaged_byte_of_a_frame_is_found():
    stream = flac.encode([PAYLOADS[2]])[0]
    first = flac._metadata(stream)[4]
    for k in range(first, len(stream), 7):
        bad = bytearray(stream)
        bad[k] ^= 0x10
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(bad)])


def test_seeking_by_frame():
    payload = flac.padded(prose(9, 2000))[1]
    stream = flac.encode([payload])[0]
    (_, blocks), = flac.decode([stream])
    offset, n, byte = blocks[3]
    x, _, _ = flac.decode_frames(stream, [byte])
    back = np.zeros(256, np.uint8)
    back[flac.sample_table("text") + 128] = np.arange(256)
    assert back[x + 128].tobytes() == payload[offset : offset + n]


def check(got, docs):
    want = sorted((str(d), len((t or "").encode()), len(p := flac.padded(t)[1]), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for d, t in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())


def test_whole_table(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(queries.op9_flac_media(spark, tiny).collect(), docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(flac.store_and_read(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert flac.store_and_read(no_documents(spark)).collect() == []


def test_blocks_as_rows(spark):
    docs = spark.createDataFrame([(1, prose(4, 900)), (2, "")], "doc_id long, text string")
    rows = flac.pcm_blocks(flac.encode_column(docs)).orderBy("doc_id", "block").collect()
    for d, t in ((1, prose(4, 900)), (2, "")):
        assert b"".join(r.pcm for r in rows if r.doc_id == d) == flac.padded(t)[1]


def test_stored_streams_have_linear_predictors(spark, tiny):
    """Subframe kinds of the table's frames: fixed ones and quantised linear ones, each where it is shorter."""
    media = [r.media for r in flac.encode_column(spark.read.parquet(f"{tiny}/documents.parquet")).collect()]
    kinds = {s[byte + flac._read_header(s, byte)[2]] >> 1 for s, (_, blocks) in zip(media, flac.decode(media), strict=True) for _, _, byte in blocks}
    assert any(k >= 32 for k in kinds) and any(k < 32 for k in kinds)


def test_a_stream_is_the_same_however_its_samples_are_grouped(monkeypatch):
    streams = flac.encode(PAYLOADS, "text", 2)
    monkeypatch.setattr(flac, "BATCH", 3 * flac.BLOCK)
    assert flac.encode(PAYLOADS, "text", 2) == streams and [p for p, _ in flac.decode(streams)] == PAYLOADS
    assert [flac.feature(*x) for x in flac.decode(streams)] == [whole_feature(p, (len(p) + flac.BLOCK - 1) // flac.BLOCK) for p in PAYLOADS]


def whole_feature(pcm, blocks):
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    above = x * len(x) >= x.sum()
    return f"blocks={blocks};peak={int(np.abs(x).max())};energy={int((x * x).sum() * 1000 // len(x))};crossings={int((above[1:] != above[:-1]).sum())}"


MEMORY = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from ticksmith.llm import flac
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
unit = "A very long text, and it goes on; number {} of many lines.\\n"
text = "".join(unit.format(k) for k in range(20_000)) * 57
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
size = len(text)
del text
base = peak()
(out,) = flac.encode_batch(batch)
coded = peak() - base
(row,) = flac.digest_batch(out)
assert row.column(1)[0].as_py() == size and row.column(2)[0].as_py() == size + -size % 64
print(size, int(coded), int(peak() - base))
"""


def test_a_very_long_text_needs_bounded_memory():
    """64 MB of text: both ways stay within 500 MB above what held the text."""
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", MEMORY, str(Path(flac.__file__).parents[2])], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    size, coded, both = map(int, done.stdout.split())
    assert size > 64e6 and coded < 500 and both < 500


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - j)) & 1 for j in range(width)]

    def rice(self, e, k):
        u = 2 * e if e >= 0 else -2 * e - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def data(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def foreign_frame(number, x, kind, method=0, parts=0, escape=()):
    """A frame as other encoders write it: constant, verbatim, or a fixed predictor with Rice partitions and escapes."""
    w = Writer()
    if kind == "constant":
        w.put(0, 8)
        w.put(x[0] & 255, 8)
    elif kind == "verbatim":
        w.put(2, 8)
        for v in x:
            w.put(v & 255, 8)
    else:
        order = kind
        w.put(16 + 2 * order, 8)
        for v in x[:order]:
            w.put(v & 255, 8)
        w.put(method, 2)
        w.put(parts, 4)
        e = [x[i] - sum(c * x[i - 1 - j] for j, c in enumerate(flac.FIXED[order])) for i in range(order, len(x))]
        size = len(x) >> parts
        for p in range(1 << parts):
            part = e[max(0, p * size - order) : (p + 1) * size - order]
            if p in escape:
                w.put((1 << (4 + method)) - 1, 4 + method)
                width = 0 if not any(part) else max(v.bit_length() for v in part) + 1
                w.put(width, 5)
                for v in part:
                    w.put(v & ((1 << width) - 1), width)
            else:
                k = p % 5
                w.put(k, 4 + method)
                for v in part:
                    w.rice(v, k)
    frame = flac._frame_header(number, len(x)) + w.data()
    return frame + slow_crc(frame, 0x8005, 16).to_bytes(2, "big")


@pytest.mark.parametrize("points", [True, False])
def test_streams_of_other_encoders(points):
    rng = np.random.default_rng(8)
    noise = lambda n, s: [int(v) for v in np.clip(np.cumsum(rng.integers(-s, s + 1, n)), -128, 127)]
    blocks = [([7] * 1024, "constant"), (noise(1024, 40), "verbatim"), (noise(1024, 3), 2, 0, 3, (1,)), (noise(1024, 3), 1, 1, 2, (0, 3)), (noise(1024, 2), 0, 0, 0), ([5] * 512 + noise(512, 2), 4, 0, 1, (0,)), ([0] * 1024, 1, 0, 4, tuple(range(16))), (noise(96, 3), 3, 1, 1)]
    frames = [foreign_frame(i, *b) for i, b in enumerate(blocks)]
    x = [v for b in blocks for v in b[0]]
    info = (1024).to_bytes(2, "big") * 2 + bytes(6) + ((flac.RATE << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    starts = np.cumsum([0, *map(len, frames)])
    seek = b"".join(int(1024 * i).to_bytes(8, "big") + int(a).to_bytes(8, "big") + len(b[0]).to_bytes(2, "big") for i, (a, b) in enumerate(zip(starts, blocks)))
    head = b"fLaC" + (b"\x00" if points else b"\x80") + len(info).to_bytes(3, "big") + info
    stream = head + (b"\x83" + len(seek).to_bytes(3, "big") + seek if points else b"") + b"".join(frames)
    ((pcm, found),) = flac.decode([stream])
    assert [v - 128 for v in pcm] == x and [n for _, n, _ in found] == [len(b[0]) for b in blocks]
    own = flac.encode(PAYLOADS[:3])
    assert [p for p, _ in flac.decode([own[0], stream, *own[1:]])] == [PAYLOADS[0], pcm, *PAYLOADS[1:3]]
