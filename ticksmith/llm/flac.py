"""FLAC media columns: 8-bit mono streams, encoded and decoded over batches of rows.

A stream has STREAMINFO (with the samples' MD5), an APPLICATION block that names the sample table, a SEEKTABLE with a
point for each frame, and frames of ``BLOCK`` samples: CRC-8 over the header, one subframe with a fixed or quantised
linear predictor, Rice-coded residuals, CRC-16 over the frame. The encoder takes, by frame, the fixed predictor of
order 0 to 4 or a linear predictor of a given order, and the Rice parameter, with the fewest bits.

The decoder reads constant, verbatim, fixed and linear subframes, Rice partitions of both kinds and their escapes, of
8-bit mono streams. Rice codes of one frame follow each other, but frames don't: it walks all frames of a batch in step, one
sample of every frame at a time, so that each step is a few array operations. CRC-16 is taken in step as well. Frames
are checked before their samples are used, and the samples against the MD5.

The sample table maps a byte to a sample. ``text`` gives bytes that are frequent in texts small samples, which Rice
codes keep short; ``linear`` is byte - 128. Both are one to one.

Defined results: null text is empty; payloads are padded by bytes 0 to a positive multiple of 64; equal texts give
equal streams; every row gives one row; an empty table gives none; other columns are ignored. Rows are worked on where
they are read; streams are written once, and never shuffled. Of a text, its bytes, its stream and its decoded samples
are held as bytes; the arrays of coding and decoding, about 150 bytes a sample, are of ``BATCH`` samples at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.storage import written

BLOCK, UNIT, RATE = 1024, 64, 8000
#: Samples that are worked on together.
BATCH = 1 << 20
#: The linear predictor's order in stored columns; a frame has one where it takes fewer bits.
LPC_ORDER = 2
#: Fixed predictors of FLAC, order 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
PRECISION = 12
#: The most frequent bytes of texts in Latin script, a fixed value; other bytes follow in order.
FREQUENT = " etaonirshldcumpfgybwvk.,\n".encode() + b"\xc3\xa9" + b"EATIOSNRCDLMPHBFWUGzxjq-'\"0123456789VKJYXZQ"


def sample_table(name: str) -> np.ndarray:
    """Samples (-128 to 127) of the 256 bytes."""
    if name == "linear":
        return np.arange(256) - 128
    if name != "text":
        raise ValueError(f"unknown sample table {name}")
    order = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)])
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    return np.where(rank % 2 == 0, rank // 2, -(rank + 1) // 2)


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (width - 8)
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ poly, out << 1) & mask
    return out


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16_of(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of ``buffer``, one byte of each at a time."""
    order = np.argsort(start - end, kind="stable")  # longest first
    start, size = start[order], (end - start)[order]
    crc = np.zeros(len(start), np.int64)
    live = len(start)
    for i in range(int(size[0]) if len(size) else 0):
        while live and size[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ buffer[start[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 of FLAC."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([~(2 * lead + 1) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, n: int) -> bytes:
    """Sync, fixed blocks; 1024 samples or a 16-bit size; rate of the stream; mono; 8 bits."""
    head = b"\xff\xf8" + bytes([0xA0 if n == BLOCK else 0x70, 0x02]) + _number(number) + (b"" if n == BLOCK else struct.pack(">H", n - 1))
    return head + bytes([crc8(head)])


def _levinson(x: np.ndarray, start: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Quantised coefficients (frames x order) with a shift of PRECISION - 1, from autocorrelation by frame."""
    at = np.concatenate([start, [len(x)]])
    lags = []
    place = np.arange(len(x)) - np.repeat(start, n)
    for lag in range(order + 1):
        p = np.zeros(len(x))
        p[lag:] = x[lag:] * x[: len(x) - lag]
        p[place < lag] = 0
        lags.append(np.add.reduceat(p, at[:-1]))
    r = np.stack(lags, 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, err = np.zeros((len(start), order)), r[:, 0].copy()
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        k = np.clip(k, -1, 1)
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (limit >> 1)), -limit, limit - 1).astype(np.int64)


def _runs(sizes: list[list[int]]) -> Iterator[list[tuple[int, int, int]]]:
    """(stream, first frame, end frame): all frames of the streams, at most ``BATCH`` samples together."""
    part, room = [], BATCH
    for d, frames in enumerate(sizes):
        first = 0
        for f, n in enumerate(frames):
            if n > room and (part or f > first):
                yield part + [(d, first, f)] * (f > first)
                part, room, first = [], BATCH, f
            room -= n
        part.append((d, first, len(frames)))
    if part:
        yield part


def encode(payloads: list[bytes], table: str = "text", lpc_order: int = 0) -> list[bytes]:
    """A stream for each payload; payloads are positive multiples of 64 bytes, worked on ``BATCH`` samples at a time."""
    sample = sample_table(table).astype(np.int32)
    sizes = [[min(BLOCK, len(p) - k) for k in range(0, len(p), BLOCK)] for p in payloads]
    frames: list[list[bytes]] = [[] for _ in payloads]
    lengths: list[list[int]] = [[] for _ in payloads]
    sums = [hashlib.md5() for _ in payloads]
    for run in _runs(sizes):
        views = [memoryview(payloads[d])[a * BLOCK : b * BLOCK] for d, a, b in run]
        x = sample[np.frombuffer(b"".join(views), np.uint8)]
        n = np.array([k for d, a, b in run for k in sizes[d][a:b]])
        data, size = _encode_frames(x, n, [f for _, a, b in run for f in range(a, b)], lpc_order)
        signed, at, byte, f = memoryview(x.astype(np.int8).tobytes()), 0, 0, 0
        for (d, a, b), view in zip(run, views, strict=True):
            own = size[f : f + b - a]
            frames[d].append(data[byte : byte + int(own.sum())])
            lengths[d] += own.tolist()
            sums[d].update(signed[at : at + len(view)])
            at, byte, f = at + len(view), byte + int(own.sum()), f + b - a
    streams = []
    for d, payload in enumerate(payloads):
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths[d]).to_bytes(3, "big") + max(lengths[d]).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + sums[d].digest()
        starts = np.cumsum([0, *lengths[d][:-1]]).tolist()
        points = b"".join(struct.pack(">QQH", i * BLOCK, a, k) for i, (a, k) in enumerate(zip(starts, sizes[d], strict=True)))
        name = table.encode().ljust(8)
        streams.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x02", (12).to_bytes(3, "big"), b"tabl", name, b"\x83", len(points).to_bytes(3, "big"), points, *frames[d]]))
        frames[d] = []
    return streams


def _encode_frames(x: np.ndarray, n: np.ndarray, number: list[int], lpc_order: int) -> tuple[bytes, np.ndarray]:
    """(bytes, size of each) of the frames of ``n`` samples that ``x`` holds one behind the other."""
    start = np.cumsum(n) - n
    frames = len(n)
    place = np.arange(len(x), dtype=np.int32) - np.repeat(start, n).astype(np.int32)

    # residuals by predictor; warm-up samples are left out of the costs
    e, kinds = x, [x]
    for order in range(1, 5):
        d = e.copy()
        d[1:] -= e[:-1]
        e = d
        kinds.append(e)
    coefficients = None
    if lpc_order:
        coefficients = _levinson(x.astype(float), start, n, lpc_order).astype(np.int32)
        guess = np.zeros(len(x), np.int32)
        for j in range(lpc_order):
            guess[j + 1 :] += np.repeat(coefficients[:, j], n)[j + 1 :] * x[: len(x) - j - 1]
        kinds.append(x - (guess >> (PRECISION - 2)))
    orders = np.array([0, 1, 2, 3, 4, lpc_order][: len(kinds)])
    best_bits, best, best_k = np.full(frames, 1 << 60), np.zeros(frames, np.int64), np.zeros(frames, np.int32)
    for kind, residual in enumerate(kinds):
        u = (residual << 1) ^ (residual >> 31)
        u[place < orders[kind]] = 0
        count = n - orders[kind]
        total = np.add.reduceat(u, start)
        k0 = np.log2(np.maximum(total / np.maximum(count, 1), 1)).astype(np.int32)
        for k in (k0, np.maximum(k0 - 1, 0)):
            bits = np.add.reduceat(u >> np.repeat(k, n), start) + count * (1 + k) + 8 * orders[kind] + (PRECISION * lpc_order if kind == 5 else 0)
            better = (bits < best_bits) & (k <= 14) & (count > 0)
            best_bits[better], best[better], best_k[better] = bits[better], kind, k[better]
    order = orders[best]
    residual = x.copy()
    chosen = np.repeat(best, n)
    for kind in np.unique(best).tolist():
        if kind:
            np.copyto(residual, kinds[kind], where=chosen == kind)
    is_lpc = best == 5
    k = best_k

    heads = [_frame_header(i, s) for i, s in zip(number, n.tolist(), strict=True)]
    head_size = np.array([len(h) for h in heads])
    u = (residual << 1) ^ (residual >> 31)
    k_of = np.repeat(k, n)
    length = (u >> k_of) + 1 + k_of
    length[place < np.repeat(order, n)] = 0
    before = np.cumsum(length) - length
    body = 8 + 8 * order + np.where(is_lpc, 9 + PRECISION * order, 0) + 10
    rice_bits = np.add.reduceat(length, start)
    frame_bytes = head_size + (body + rice_bits + 7) // 8 + 2
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    first = (frame_at + head_size) * 8 + body
    coded = np.flatnonzero(length)
    pos = np.repeat(first - before[start], n)[coded] + before[coded]
    u, k_of, length = u[coded], k_of[coded], length[coded]
    bits[pos + length - 1 - k_of] = 1
    last = pos + length - 1
    for j in range(int(k_of.max()) if len(k_of) else 0):
        has = k_of > j
        if has.all():
            bits[last - j] = (u >> j) & 1
        else:
            bits[(last - j)[has]] = (u[has] >> j) & 1

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1

    sub = (frame_at + head_size) * 8
    put(sub, np.where(is_lpc, 2 * (order + 31), 16 + 2 * order), 8)
    for j in range(int(order.max())):
        has = order > j
        put(sub[has] + 8 + 8 * j, x[start[has] + j] & 0xFF, 8)
    if is_lpc.any():
        at = sub[is_lpc] + 8 + 8 * lpc_order
        put(at, np.full(len(at), (PRECISION - 1) << 5 | (PRECISION - 2)), 9)
        for j in range(lpc_order):
            put(at + 9 + PRECISION * j, coefficients[is_lpc, j] & ((1 << PRECISION) - 1), PRECISION)
    put(first - 10, k, 10)  # method 0, one partition, its parameter
    out = np.packbits(bits)
    for a, h in zip(frame_at.tolist(), heads, strict=True):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    end = frame_at + frame_bytes - 2
    crc = crc16_of(out, frame_at, end)
    out[end], out[end + 1] = crc >> 8, crc & 0xFF

    return out.tobytes(), frame_bytes


# --- decoding


def _metadata(stream: bytes) -> tuple[int, bytes, str, list[tuple[int, int, int]], int]:
    """(samples, MD5, sample table, seek points, where frames begin)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, samples, md5, table, points = 4, 0, b"", "linear", []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 127 == 0:
            word = int.from_bytes(block[10:18], "big")
            if word >> 41 & 7 or (word >> 36 & 31) != 7:
                raise ValueError("only 8-bit mono streams are decoded")
            samples, md5 = word & ((1 << 36) - 1), block[18:34]
        elif kind & 127 == 2 and block[:4] == b"tabl":
            table = block[4:].decode().strip()
        elif kind & 127 == 3:
            points = list(struct.iter_unpack(">QQH", block))
        if kind & 128:
            return samples, md5, table, points, at


def _read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, samples, header size) of a frame whose header checksum holds."""
    if data[at : at + 2] != b"\xff\xf8":
        raise ValueError("frame without sync code")
    code = data[at + 2] >> 4
    lead = data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & (0x7F >> more)
    for b in data[at + 5 : at + 4 + max(more, 1)]:
        number = number << 6 | b & 0x3F
    p = at + 4 + max(more, 1)
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif code == 1:
        n = 192
    elif 2 <= code <= 5:
        n = 576 << (code - 2)
    elif code >= 8:
        n = 256 << (code - 8)
    else:
        raise ValueError("reserved block size")
    if crc8(data[at:p]) != data[p]:
        raise ValueError("frame header doesn't match its checksum")
    return number, n, p + 1 - at


def decode_frames(data: bytes, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples of all frames in order, samples by frame, end of each frame) of the frames at ``at``, in step."""
    buffer = np.frombuffer(data, np.uint8)
    heads = [_read_header(data, a) for a in at]
    start = np.array(at)
    n = np.array([h[1] for h in heads])
    sub = start + np.array([h[2] for h in heads])
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
    window = np.zeros(len(buffer) + 8, np.uint64)  # 64 bits from each byte on
    for j in range(8):
        window = (window << np.uint64(8)) | padded[j : j + len(window)]
    bits = np.unpackbits(padded)
    marks = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    next_one = np.minimum.accumulate(marks[::-1])[::-1]

    def take(pos: np.ndarray, width) -> np.ndarray:
        """``width`` (up to 57) bits at bit positions."""
        w = window[pos >> 3] << (pos & 7).astype(np.uint64)
        return ((w >> (np.uint64(63) - np.asarray(width).astype(np.uint64))) >> np.uint64(1)).astype(np.int64)

    kind = buffer[sub].astype(np.int64) >> 1
    if (buffer[sub] & 1).any() or not ((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)).all():
        raise ValueError("only constant, verbatim, fixed and linear subframes are decoded")
    is_lpc = kind >= 32
    order = np.where(is_lpc, kind - 31, np.maximum(kind - 8, 0))
    most = int(order.max())
    where = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.int64)
    for f in np.flatnonzero(kind <= 1).tolist():  # one byte for all samples, or one for each
        v = buffer[sub[f] + 1 : sub[f] + 1 + (n[f] if kind[f] else 1)].astype(np.int64)
        out[where[f] : where[f] + n[f]] = v - 256 * (v > 127)
    for j in range(most):
        has = order > j
        v = buffer[sub[has] + 1 + j].astype(np.int64)
        out[where[has] + j] = v - 256 * (v > 127)
    pos = (sub + 1 + np.where(kind <= 1, np.where(kind == 1, n, 1), order)) * 8
    weights = np.zeros((len(at), max(most, 1)), np.int64)
    shift = np.zeros(len(at), np.int64)
    for p in range(1, min(4, most) + 1):
        weights[(~is_lpc) & (order == p), :p] = FIXED[p]
    if is_lpc.any():
        width = take(pos, 4) + 1
        shift = np.where(is_lpc, take(pos + 4, 5), 0)
        pos = pos + np.where(is_lpc, 9, 0)
        for j in range(most):
            has = is_lpc & (order > j)
            v = take(pos[has], width[has])
            weights[has, j] = v - (v >> (width[has] - 1) << width[has])
            pos = pos + np.where(has, width, 0)
    coded = kind >= 8
    method, parts = take(pos, 2), take(pos + 2, 4)
    if (method[coded] > 1).any() or (n[coded] % (1 << parts[coded])).any():
        raise ValueError("reserved residual coding")
    pos = pos + np.where(coded, 6, 0)
    # frames with the most residuals first: those still going are a prefix
    rest = np.where(coded, n - order, 0)
    turn = np.argsort(-rest, kind="stable")
    pos, rest, to = pos[turn], rest[turn], (where + order)[turn]
    order, shift, weights = order[turn], shift[turn], weights[turn]
    size, wide = (n >> parts)[turn], 4 + method[turn]  # residuals of a partition, and bits of its parameter
    k, raw = np.zeros(len(turn), np.int64), np.full(len(turn), -1)
    due = np.where(rest > 0, 0, -1)  # the residual that the next partition begins with
    predicted = np.flatnonzero(order)
    live = len(turn)
    for i in range(int(rest[0]) if live else 0):
        while rest[live - 1] <= i:
            live -= 1
        new = np.flatnonzero(due[:live] == i)
        if len(new):
            k[new] = take(pos[new], wide[new])
            pos[new] += wide[new]
            escape = new[k[new] == (1 << wide[new]) - 1]
            raw[new] = -1
            raw[escape] = take(pos[escape], 5)  # residuals as they are, of so many bits
            pos[escape] += 5
            due[new] = np.where(i == 0, size[new] - order[new], i + size[new])
        p, kk = pos[:live], k[:live]
        one = next_one[p].astype(np.int64)
        u = (one - p << kk) | take(one + 1, kk)
        value, after = (u >> 1) ^ -(u & 1), one + 1 + kk
        plain = np.flatnonzero(raw[:live] >= 0) if (raw[:live] >= 0).any() else ()
        if len(plain):
            v = take(pos[plain], raw[plain])
            value[plain] = v - (v >> np.maximum(raw[plain] - 1, 0) << raw[plain])
            after[plain] = pos[plain] + raw[plain]
        pos[:live] = after
        if len(predicted):
            f = predicted[predicted < live]
            at_f = to[f] + i
            guess = np.zeros(len(f), np.int64)
            for j in range(most):
                guess += weights[f, j] * out[np.maximum(at_f - 1 - j, 0)]
            value[f] += guess >> shift[f]
        out[to[:live] + i] = value
    end = np.empty_like(pos)
    end[turn] = (pos + 7) // 8
    if (crc16_of(buffer, start, end) != (buffer[end].astype(np.int64) << 8 | buffer[end + 1])).any():
        raise ValueError("frame doesn't match its checksum")
    return out, n, end + 2


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """(payload, blocks: sample offset, samples, byte offset of the frame) of each stream, verified.

    Frames are decoded ``BATCH`` samples at a time, whatever a stream's length.
    """
    infos = [_metadata(s) for s in streams]
    backs = {}
    for _, _, table, _, _ in infos:
        if table not in backs:
            backs[table] = np.zeros(256, np.uint8)
            backs[table][sample_table(table) + 128] = np.arange(256)
    pcm: list[list[bytes]] = [[] for _ in streams]
    sums = [hashlib.md5() for _ in streams]
    at: list[list[int]] = []  # where each stream's frames begin, and its end
    sizes: list[list[int]] = []

    def take(d: int, x: np.ndarray) -> None:
        sums[d].update(x.astype(np.int8).tobytes())
        pcm[d].append(backs[infos[d][2]][x + 128].tobytes())

    for d, (s, (samples, _, _, points, first)) in enumerate(zip(streams, infos, strict=True)):
        if sum(p[2] for p in points) == samples and points:
            at.append([first + p[1] for p in points] + [len(s)])
            sizes.append([p[2] for p in points])
        else:  # a stream without a point for each frame is walked frame by frame
            at.append([first])
            sizes.append([])
            longest = int.from_bytes(s[15:18], "big") or len(s)
            while at[d][-1] < len(s):
                x, n, e = decode_frames(s[at[d][-1] : at[d][-1] + longest], [0])
                take(d, x)
                sizes[d].append(int(n[0]))
                at[d].append(at[d][-1] + int(e[0]))
    for run in _runs([n if not done else [] for n, done in zip(sizes, pcm, strict=True)]):
        data = b"".join(streams[d][at[d][a] : at[d][b]] for d, a, b in run if b > a)
        begin, base = [], 0
        for d, a, b in run:
            begin += [base + k - at[d][a] for k in at[d][a:b]]
            base += at[d][b] - at[d][a]
        if not begin:
            continue
        x, n, _ = decode_frames(data, begin)
        if n.tolist() != [k for d, a, b in run for k in sizes[d][a:b]]:
            raise ValueError("frames don't match the seek table")
        where = 0
        for d, a, b in run:
            size = sum(sizes[d][a:b])
            if size:
                take(d, x[where : where + size])
            where += size
    out = []
    for d, (samples, md5, _, _, _) in enumerate(infos):
        if sum(sizes[d]) != samples or sums[d].digest() != md5:
            raise ValueError("samples don't match the stream's MD5")
        offsets = np.cumsum([0, *sizes[d]]).tolist()
        out.append((b"".join(pcm[d]), list(zip(offsets[:-1], sizes[d], at[d][: len(sizes[d])], strict=True))))
        pcm[d] = []
    return out


# --- columns


def padded(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, padded to a positive multiple of UNIT, and their number before."""
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Buffer | None]]]:
    """Rows with the bytes of one column, about ``BATCH`` bytes together; a longer value comes alone or last."""
    first, size, part = 0, 0, []
    for k, x in enumerate(batch.column(column)):
        part.append(x.as_buffer())
        size += len(part[-1] or b"")
        if size >= BATCH or k + 1 == batch.num_rows:
            yield batch.slice(first, k + 1 - first), part
            first, size, part = k + 1, 0, []


def encode_column(docs: DataFrame, table: str = "text", lpc_order: int = LPC_ORDER) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encode_batch(batch, table, lpc_order)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def encode_batch(batch: pa.RecordBatch, table: str = "text", lpc_order: int = LPC_ORDER) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as rows (doc_id, n_bytes, media), a few at a time."""
    for part, texts in _groups(batch, 1):
        sizes = [len(t or b"") for t in texts]
        media = encode([b"".join([t or b"", bytes(-n % UNIT if n else UNIT)]) for t, n in zip(texts, sizes, strict=True)], table, lpc_order)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, byte_offset, pcm): decoded blocks; a reader can seek by either offset."""
    names = ["doc_id", "block", "sample_offset", "n_samples", "byte_offset", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, streams in _groups(batch, 1):
                found = decode([s.to_pybytes() for s in streams])
                rows = [(d, i, a, n, at, pcm[a : a + n]) for d, (pcm, blocks) in zip(part.column(0).to_pylist(), found, strict=True) for i, (a, n, at) in enumerate(blocks)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "pcm" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, byte_offset long, pcm binary")


def feature(pcm: bytes, blocks: list) -> str:
    """Loudness and shape of a signal of 8-bit samples, in whole numbers: blocks, peak, energy and crossings of the mean."""
    bytes_ = np.frombuffer(pcm, np.uint8)
    parts = [bytes_[k : k + BATCH] for k in range(0, len(bytes_), BATCH)]
    count, x = sum(np.bincount(p, minlength=256) for p in parts), np.arange(256) - 128
    least = -(-int((count * x).sum()) // len(bytes_)) + 128  # bytes from this one on are above the mean, or on it
    crossings = sum(int(np.count_nonzero(np.diff(p >= least))) for p in parts) + sum(int((a[-1] >= least) != (b[0] >= least)) for a, b in zip(parts, parts[1:]))
    return f"blocks={len(blocks)};peak={int(np.abs(x[count > 0]).max())};energy={int((count * x * x).sum() * 1000 // len(bytes_))};crossings={crossings}"


_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """Digests and features of each stored stream, decoded and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from digest_batch(batch)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DDL)


def digest_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, media) as rows of digests, a few at a time."""
    names = [x.split()[0] for x in _DDL.split(", ")]
    for part, buffers in _groups(batch, 2):
        rows = []
        streams = [b.to_pybytes() for b in buffers]
        for d, n, s, (pcm, blocks) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), streams, decode(streams), strict=True):
            rows.append((d, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), feature(pcm, blocks)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n or n == "feature" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def store_and_read(docs: DataFrame) -> DataFrame:
    return media_digests(written(encode_column(docs), "flac"))
