"""FLAC columns: decoding to PCM blocks with sample offsets, and an encoder to make such columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_CODES = {v: k for k, v in _BITS.items()}
_FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
PCM = pa.schema({"block": pa.int32(), "sample_offset": pa.int64(), "n_samples": pa.int32(), "channels": pa.int32(), "sample_rate": pa.int32(), "bits": pa.int32(), "pcm": pa.binary(), "error": pa.string()})


class Damaged(ValueError):
    """The stream isn't FLAC, or a checksum is wrong."""


class Early(Damaged):
    """More bits are asked for than there are."""


class Crc:
    """A cyclic redundancy check as an exclusive or of what each byte gives at its distance from the end."""

    def __init__(self, poly: int, width: int):
        top, mask, t = 1 << (width - 1), (1 << width) - 1, []
        for b in range(256):
            c = b << (width - 8)
            for _ in range(8):
                c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
            t.append(c)
        self.few, self.step, self.width, self.given = t, np.array(t, np.uint32), width, np.array([t], np.uint16)

    def __call__(self, data: np.ndarray) -> int:
        while len(self.given) < len(data):  # one more byte of distance: shift in a zero
            last, more = self.given[-1].astype(np.uint32), []
            for _ in range(max(256, len(data) - len(self.given))):
                last = ((last << 8) & ((1 << self.width) - 1)) ^ self.step[last >> (self.width - 8)]
                more.append(last.astype(np.uint16))
            self.given = np.concatenate([self.given, np.stack(more)])
        return int(np.bitwise_xor.reduce(self.given[np.arange(len(data) - 1, -1, -1), data])) if len(data) else 0


    def of_few(self, data: list[int]) -> int:
        """The same of a few bytes."""
        c = 0
        for b in data:
            c = (c << 8 & (1 << self.width) - 1) ^ self.few[(c >> self.width - 8) ^ b]
        return c


CRC8, CRC16 = Crc(0x07, 8), Crc(0x8005, 16)


class _Bits:
    """The bits of a byte array, read forward; `next_one` holds, for each place, that of the next 1."""

    def __init__(self, data: np.ndarray, at: int = 0):
        self.bits, self.at = np.unpackbits(data), at
        ones = np.flatnonzero(self.bits)
        nxt = np.full(len(self.bits) + 1, len(self.bits), np.int64)
        nxt[ones] = ones
        self.next_one = np.minimum.accumulate(nxt[::-1])[::-1]
        self.list = self.next_one.tolist()

    def uint(self, n: int) -> int:
        self.at += n
        if self.at > len(self.bits):
            raise Early("the frame ends early")
        return int("".join("1" if b else "0" for b in self.bits[self.at - n : self.at].tolist()) or "0", 2)

    def sint(self, n: int) -> int:
        v = self.uint(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def sints(self, count: int, n: int) -> np.ndarray:
        if self.at + count * n > len(self.bits):
            raise Early("the frame ends early")
        got = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        self.at += count * n
        return np.where(got >> (n - 1), got - (1 << n), got) if n else got

    def unary(self) -> int:
        one = self.list[self.at]
        got, self.at = one - self.at, one + 1
        if self.at > len(self.bits):
            raise Early("the frame ends early")
        return got

    def rice(self, count: int, k: int) -> np.ndarray:
        nxt, p, n, stops = self.list, self.at, len(self.bits), []
        for _ in range(count):
            p = nxt[p]
            stops.append(p)
            p += 1 + k
            if p > n:
                raise Early("the frame ends early")
        stop = np.array(stops, np.int64)
        begin = np.concatenate([[self.at], stop[:-1] + 1 + k])
        u = (stop - begin) << k
        for i in range(k):
            u |= self.bits[stop + 1 + i].astype(np.int64) << (k - 1 - i)
        self.at = p
        return (u >> 1) ^ -(u & 1)


def _residual(r: _Bits, block: int, order: int) -> np.ndarray:
    method, partitions = r.uint(2), 1 << r.uint(4)
    if method > 1 or block % partitions or block // partitions < order:
        raise Damaged("the residual's partitions are wrong")
    width, parts = 4 + method, []
    for i in range(partitions):
        k, n = r.uint(width), block // partitions - (order if not i else 0)
        parts.append(r.sints(n, r.uint(5)) if k == (1 << width) - 1 else r.rice(n, k))
    return np.concatenate(parts)


def _predict(warm: np.ndarray, residual: np.ndarray, coefs: list[int], shift: int) -> np.ndarray:
    if coefs in _FIXED and not shift:  # differences of this order: sum them up
        x, order = residual, len(coefs)
        for i in range(order - 1, -1, -1):
            start = np.diff(warm, i)[-1] if order else 0
            x = np.cumsum(x) + start
        return np.concatenate([warm, x])
    out, order = warm.tolist(), len(coefs)
    back = coefs[::-1]
    for e in residual.tolist():
        out.append(e + (sum(map(int.__mul__, back, out[-order:])) >> shift))
    return np.array(out, np.int64)


def _subframe(r: _Bits, block: int, bits: int) -> np.ndarray:
    if r.uint(1):
        raise Damaged("a subframe begins with 1")
    kind, wasted = r.uint(6), 0
    if r.uint(1):
        wasted = r.unary() + 1
        bits -= wasted
        if bits < 1:
            raise Damaged("a subframe has no bits")
    if kind == 0:
        x = np.full(block, r.sint(bits), np.int64)
    elif kind == 1:
        x = r.sints(block, bits)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > block:
            raise Damaged("the predictor is longer than the block")
        warm, coefs, shift = r.sints(order, bits), _FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = r.uint(4) + 1
            shift = r.sint(5)
            if precision == 16 or shift < 0:
                raise Damaged("the predictor's precision or shift is reserved")
            coefs = r.sints(order, precision).tolist()
        x = _predict(warm, _residual(r, block, order), coefs, shift)
    else:
        raise Damaged("a subframe's type is reserved")
    return x << wasted


def _header(data: np.ndarray, at: int, info: dict) -> tuple[int, int, int, int, int, int]:
    """Of the frame at a place: bytes of its header, block, bits, channel code, number of channels, and the sample offset."""
    head = data[at : at + 16].tolist()
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Damaged("no frame begins here")
    size_code, channel_code, bits_code = head[2] >> 4, head[3] >> 4, head[3] >> 1 & 7
    lead = 0
    while head[4] << lead & 0x80:
        lead += 1
    more = max(0, lead - 1)
    if lead == 1 or lead > 7 or len(head) < 6 + more:
        raise Damaged("the frame's number is wrong")
    number = head[4] & (0x7F >> lead)
    for b in head[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    p = 5 + more
    if not size_code or channel_code > 10:
        raise Damaged("a reserved code")
    block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8) if size_code > 7 else 0
    if size_code in (6, 7):
        n = size_code - 5
        block = int.from_bytes(bytes(head[p : p + n]), "big") + 1
        p += n
    p += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if p >= len(head) or CRC8.of_few(head[:p]) != head[p]:
        raise Damaged("the header's checksum is wrong")
    channels = channel_code + 1 if channel_code < 8 else 2
    return p + 1, block, _BITS.get(bits_code, info["bits"]), channel_code, channels, number if head[1] & 1 else number * info["fixed_block"]


#: Which of two channels is the difference, by channel code; it has one more bit.
_SIDE = {8: 1, 9: 0, 10: 1}


def _joined(x: list[np.ndarray], channel_code: int) -> list[np.ndarray]:
    """Left and right."""
    if channel_code == 8:
        return [x[0], x[0] - x[1]]
    if channel_code == 9:
        return [x[0] + x[1], x[1]]
    if channel_code == 10:
        mid = x[0] << 1 | x[1] & 1
        return [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return x


def _frame(data: np.ndarray, at: int, info: dict) -> tuple[np.ndarray, int, int, int]:
    """(samples x channels, sample offset, where the next frame begins, bits of a sample)."""
    p, block, bits, channel_code, channels, begin = _header(data, at, info)
    span = p + 8 + channels * (block * (bits + 3) // 8 + 64) + 1024  # of a frame that isn't badly coded
    side = _SIDE.get(channel_code, -1)
    while True:
        r = _Bits(data[at : at + span], 8 * p)
        try:
            x = [_subframe(r, block, bits + (c == side)) for c in range(channels)]
            break
        except Early:
            if at + span >= len(data):
                raise
            span *= 4
        except (OverflowError, IndexError, ValueError) as e:
            raise e if isinstance(e, Damaged) else Damaged("the frame's samples are out of range") from e
    end = at + (r.at + 7) // 8
    if end + 2 > len(data) or CRC16(data[at:end]) != int(data[end]) << 8 | int(data[end + 1]):
        raise Damaged("the frame's checksum is wrong")
    return _checked(np.stack(_joined(x, channel_code), 1), bits), begin, end + 2, bits


def _checked(x: np.ndarray, bits: int) -> np.ndarray:
    if x.size and (x.max() >= 1 << (bits - 1) or x.min() < -(1 << (bits - 1))):
        raise Damaged("a sample has more bits than the frame says")
    return x


def stream_info(data: np.ndarray) -> tuple[dict, int]:
    """STREAMINFO, and where the first frame begins."""
    raw = data.tobytes()
    if raw[:4] != b"fLaC":
        raise Damaged("it isn't FLAC")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(raw):
            raise Damaged("the metadata end early")
        last, kind, n = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + n]
        if kind == 0 and len(body) >= 34:
            v = int.from_bytes(body[10:18], "big")
            info = {"fixed_block": int.from_bytes(body[2:4], "big"), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        at += 4 + n
    if info is None:
        raise Damaged("there is no STREAMINFO")
    return info, at


def pcm_bytes(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes."""
    n = (bits + 7) // 8
    if n in (1, 2, 4):
        return x.astype(f"<i{n}").tobytes()
    return x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :n].tobytes()


def decode(raw: bytes, resume: bool = False) -> list[dict]:
    """The PCM blocks of a stream, one for each frame; what is damaged ends the list with a row that says so.

    resume: damage ends nothing. A row with the error stands where each gap begins, and after it come the next frames
    whose checksums hold, at their own offsets. Samples have the width that their frame names.
    """
    rows, offset, info = [], 0, {"rate": 0, "bits": 0, "channels": 0}
    row = lambda **x: {"block": len(rows), "sample_offset": offset, "n_samples": 0, "channels": info["channels"], "sample_rate": info["rate"], "bits": info["bits"], "pcm": None, "error": None} | x
    try:
        data = np.frombuffer(raw, np.uint8)
        info, at = stream_info(data)
        total, syncs = hashlib.md5(), None
        while at < len(data):
            try:
                x, begin, at, bits = _frame(data, at, info)
            except Damaged as e:
                if not resume:
                    raise
                if not rows or not rows[-1]["error"]:
                    rows.append(row(error=str(e)))
                if syncs is None:
                    syncs = _syncs(data)
                at = int(next(iter(syncs[np.searchsorted(syncs, at, "right") :][:1]), len(data)))
                continue
            if rows and begin != offset and not (resume and rows[-1]["error"]):
                if not resume:
                    offset = begin
                    raise Damaged("a frame is missing")
                rows.append(row(error="a frame is missing"))
            offset = begin
            rows.append(row(n_samples=len(x), channels=x.shape[1], bits=bits, pcm=(p := pcm_bytes(x, bits))))
            total.update(p)
            offset += len(x)
        hurt = any(r["error"] for r in rows)
        if info["samples"] and info["samples"] != offset and not (hurt and rows[-1]["error"]):
            raise Damaged("samples are missing")
        if any(info["md5"]) and not hurt and info["md5"] != total.digest():
            raise Damaged("the checksum of all samples is wrong")
    except Damaged as e:
        rows.append(row(error=str(e)))
    return rows


def _syncs(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8))


# --- many frames at once ---

#: Samples that frames decoded together may have, and bytes of streams held at once; they bound memory.
LANE_SAMPLES, STREAM_BYTES = 2_000_000, 4_000_000


def decode_many(streams: list[bytes]) -> list[list[dict]]:
    """decode(raw, resume=True) of each stream, with all frames of all streams in step.

    A frame ends where the next header whose checksum holds makes its own checksum hold. All subframes advance together:
    one vectorised step reads the next Rice code, or predicts the next sample, of every frame. A stream of which anything
    is wrong is left to `decode`.
    """
    results: list[list[dict] | None] = [None] * len(streams)
    infos, frames = {}, []
    for i, raw in enumerate(streams):
        data = np.frombuffer(raw, np.uint8)
        try:
            infos[i], at = stream_info(data)
            mine = _bounds(data, at, infos[i])
        except Damaged:
            infos.pop(i, None)
            continue
        frames += [(i, *f) for f in mine]
    decoded, low = {}, 0
    while low < len(frames):  # frames of about LANE_SAMPLES samples
        high, size = low, 0
        while high < len(frames) and (high == low or size + frames[high][4] * frames[high][7] <= LANE_SAMPLES):
            size += frames[high][4] * frames[high][7]
            high += 1
        for k, got in zip(range(low, high), _in_step(streams, frames[low:high])):
            decoded[k] = got
        low = high
    by: dict[int, list[int]] = {i: [] for i in infos}
    for k, f in enumerate(frames):
        by[f[0]].append(k)
    for i, info in infos.items():
        offset, rows, total = 0, [], hashlib.md5()
        for k in by[i]:
            got, begin = decoded[k], frames[k][8]
            if got is None or rows and begin != offset:
                break
            pcm, n, channels, bits = got
            offset = begin + n
            rows.append({"block": len(rows), "sample_offset": begin, "n_samples": n, "channels": channels, "sample_rate": info["rate"], "bits": bits, "pcm": pcm, "error": None})
            total.update(pcm)
        else:
            if (not info["samples"] or info["samples"] == offset) and (not any(info["md5"]) or info["md5"] == total.digest()):
                results[i] = rows
    return [decode(raw, resume=True) if rows is None else rows for raw, rows in zip(streams, results)]


def _bounds(data: np.ndarray, at: int, info: dict) -> list[tuple]:
    """(begin, end, header bytes, block, bits, channel code, channels, sample offset) of each frame, or Damaged."""
    syncs, out = [*_syncs(data[at:]).tolist(), len(data) - at], []
    if at == len(data):
        return out
    heads = []
    for x in syncs[:-1]:
        try:
            heads.append((at + x, _header(data, at + x, info)))
        except Damaged:
            continue
    if not heads or heads[0][0] != at:
        raise Damaged("no frame begins here")
    i = 0
    while i < len(heads):
        begin, head = heads[i]
        for j in range(i + 1, len(heads) + 1):
            end = heads[j][0] if j < len(heads) else len(data)
            if end - 2 > begin + head[0] and CRC16(data[begin:end]) == 0:
                break
        else:
            raise Damaged("the frame's checksum is wrong")
        out.append((begin, end, *head))
        i = j
    return out


class _Lanes:
    """Bits of one byte array, read at many places at once."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        self.eights = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(data) + 9,), (1,))
        self.at, self.end, self.good = at, 8 * len(data), np.ones(len(at), bool)

    def window(self, lanes: np.ndarray) -> np.ndarray:
        """57 bits or more from each lane's place, at the top of 64."""
        p = np.minimum(self.at[lanes], self.end)
        return self.eights[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def uint(self, lanes: np.ndarray, n) -> np.ndarray:
        """The next n bits (one number, or one for each lane; 0 to 57)."""
        n = np.broadcast_to(np.asarray(n, np.int64), lanes.shape)
        got = np.where(n > 0, self.window(lanes) >> np.minimum(64 - n, 63).astype(np.uint64), np.uint64(0)).astype(np.int64)
        self.at[lanes] += n
        return got

    def sint(self, lanes: np.ndarray, n) -> np.ndarray:
        got, n = self.uint(lanes, n), np.asarray(n, np.int64)
        return np.where((n > 0) & (got >> np.maximum(n - 1, 0) > 0), got - (np.int64(1) << n), got)

    def unary(self, lanes: np.ndarray) -> np.ndarray:
        """Zeros before the next 1."""
        zeros, open_ = np.zeros(len(lanes), np.int64), np.arange(len(lanes))
        while len(open_):
            top = (self.window(lanes[open_]) >> np.uint64(32)).astype(np.float64)
            none = top == 0
            n = np.where(none, 32, 32 - np.frexp(top)[1])
            zeros[open_] += n
            self.at[lanes[open_]] += n + ~none
            open_ = open_[none & (self.at[lanes[open_]] < self.end)]
        return zeros


def _in_step(streams: list[bytes], frames: list[tuple]) -> list[tuple | None]:
    """(pcm, samples, channels, bits) of each frame (stream, begin, end, header bytes, block, ...), None for what isn't as it should be."""
    data = np.frombuffer(b"".join(streams[f[0]][f[1] : f[2]] for f in frames), np.uint8)
    _, begin, end, head, block, bits, code, channels, _ = (np.array(x, np.int64) for x in zip(*frames))
    start = np.cumsum(end - begin) - (end - begin)
    r = _Lanes(data, 8 * (start + head))
    side = np.select([code == 8, code == 9, code == 10], [1, 0, 1], -1)
    parts = []
    for c in range(int(channels.max())):
        lanes = np.flatnonzero((channels > c) & r.good)
        x = np.zeros((int(block.max()), len(frames)), np.int64)
        _subframes(r, lanes, block, bits + (side == c), x)
        parts.append(x)
    r.good &= (r.at + 7) // 8 == start + end - begin - 2
    out = []
    for i in range(len(frames)):
        n, wide, count = int(block[i]), int(bits[i]), int(channels[i])
        x = _joined([p[:n, i] for p in parts[:count]], int(code[i]))
        x = np.stack(x, 1) if count > 1 else x[0]
        out.append((pcm_bytes(x, wide), n, count, wide) if r.good[i] and x.max() < 1 << (wide - 1) and x.min() >= -(1 << (wide - 1)) else None)
    return out


def _subframes(r: _Lanes, lanes: np.ndarray, blocks: np.ndarray, widths: np.ndarray, x: np.ndarray) -> None:
    """The next subframe of each lane, into x (samples x all lanes). Lanes that aren't as they should be are no longer good."""

    def drop(which: np.ndarray) -> None:
        r.good[which] = False

    drop(lanes[r.uint(lanes, 1) != 0])
    kind, wasted = r.uint(lanes, 6), np.zeros(len(lanes), np.int64)
    some = np.flatnonzero(r.uint(lanes, 1))
    wasted[some] = r.unary(lanes[some]) + 1
    n, wide = blocks[lanes], widths[lanes] - wasted
    predicted = ((kind >= 8) & (kind <= 12)) | (kind >= 32)
    order = np.where(kind >= 32, kind - 31, np.where(predicted, kind - 8, 0))
    drop(lanes[(wide < 1) | ((kind > 1) & ~predicted) | (order > n)])
    good = r.good[lanes]

    def signed(which: np.ndarray, count: np.ndarray) -> None:
        """count samples of each of these lanes as they are."""
        for t in range(int(count[which].max(initial=0))):
            now = which[count[which] > t]
            x[t, lanes[now]] = r.sint(lanes[now], wide[now])

    constant = np.flatnonzero(good & (kind == 0))
    if len(constant):
        value = r.sint(lanes[constant], wide[constant])
        x[:, lanes[constant]] = np.where(np.arange(len(x))[:, None] < n[constant], value, 0)
    signed(np.flatnonzero(good & (kind == 1)), n)
    coded = np.flatnonzero(good & predicted)
    signed(coded, order)
    coefs, shift = np.zeros((32, len(lanes)), np.int64), np.zeros(len(lanes), np.int64)
    linear = coded[kind[coded] >= 32]
    if len(linear):
        precision = r.uint(lanes[linear], 4) + 1
        shift[linear] = r.sint(lanes[linear], 5)
        bad = (precision == 16) | (shift[linear] < 0)
        drop(lanes[linear[bad]])
        for j in range(int(order[linear].max())):
            now = order[linear] > j
            coefs[j, linear[now]] = r.sint(lanes[linear[now]], precision[now])
    _residuals(r, lanes, coded[r.good[lanes[coded]]], n, order, x)
    coded = coded[r.good[lanes[coded]]]
    fixed = coded[kind[coded] < 32]
    for o in np.unique(order[fixed]).tolist():
        if o:
            mine = lanes[fixed[order[fixed] == o]]
            warm, res = x[:o, mine], x[o:, mine]
            for i in range(o - 1, -1, -1):
                res = np.cumsum(res, 0) + np.diff(warm, i, axis=0)[-1]
            x[o:, mine] = res
    linear = linear[r.good[lanes[linear]]]
    for o in np.unique(order[linear]).tolist():
        which = linear[order[linear] == o]
        y, c, s = x[:, lanes[which]], coefs[:o, which][::-1].copy(), shift[which]
        for t in range(o, int(n[which].max())):
            y[t] += (c * y[t - o : t]).sum(0) >> s
        x[:, lanes[which]] = y
    lost = np.arange(len(x))[:, None] >= n
    if lost.any():
        x[:, lanes] = np.where(lost, 0, x[:, lanes])
    if wasted.any():
        x[:, lanes] <<= wasted


def _residuals(r: _Lanes, lanes: np.ndarray, coded: np.ndarray, n: np.ndarray, order: np.ndarray, x: np.ndarray) -> None:
    """Residuals of the lanes `coded`, below their warm-up samples."""
    if not len(coded):
        return
    at = lanes[coded]
    method, parts = r.uint(at, 2), np.int64(1) << r.uint(at, 4)
    n, order = n[coded], order[coded]
    size = n // parts
    bad = (method > 1) | (n % parts != 0) | (size < order)
    r.good[at[bad]] = False
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)  # raw: bits of samples that aren't Rice codes
    place, stop = order.copy(), np.zeros(len(at), np.int64)  # of the next sample, and of the partition's end
    open_ = np.flatnonzero(~bad & (place < n))
    first = True
    while len(open_):
        turn = open_[place[open_] >= stop[open_]]  # a partition begins
        while len(turn):
            k[turn] = r.uint(at[turn], 4 + method[turn])
            raw[turn] = -1
            plain = turn[k[turn] == (1 << 4 + method[turn]) - 1]
            raw[plain] = r.uint(at[plain], 5)
            stop[turn] += size[turn]
            turn = turn[place[turn] >= stop[turn]] if first else turn[:0]  # the warm-up samples may fill the first
        first = False
        some_raw = (raw[open_] >= 0).any()
        run = int((stop[open_] - place[open_]).min())  # samples until the next partition of any lane
        rice = open_[raw[open_] < 0] if some_raw else open_
        plain = open_[raw[open_] >= 0] if some_raw else open_[:0]
        _codes(r, at[rice], k[rice], place[rice], run, x)
        for i in range(run if len(plain) else 0):
            x[place[plain] + i, at[plain]] = r.sint(at[plain], raw[plain])
        place[open_] += run
        over = open_[r.at[at[open_]] > r.end]
        r.good[at[over]] = False
        open_ = open_[(place[open_] < n[open_]) & (r.at[at[open_]] <= r.end)]


def _codes(r: _Lanes, at: np.ndarray, k: np.ndarray, place: np.ndarray, run: int, x: np.ndarray) -> None:
    """`run` Rice codes of each lane."""
    if not len(at):
        return
    p, end, eights = r.at[at], r.end, r.eights
    k64, wide, one = k.astype(np.uint64), np.uint64(64), np.uint64(1)
    most, even = int(k.max()), bool((place == place[0]).all())
    for i in range(run):
        w = eights[np.minimum(p, end) >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1].astype(np.int64)
        if not top.all():  # a long run of zeros
            r.at[at] = p
            q = r.unary(at)
            p = r.at[at] - 1
            w = np.zeros(len(at), np.uint64)
            u = (q << k) | r.uint(at, k)
            p = r.at[at].copy()
        else:
            if int(q.max()) + most > 55:
                r.at[at] = p + q + 1
                tail = r.uint(at, k)
            else:
                tail = ((w << (q + 1).astype(np.uint64)) >> one >> (wide - one - k64)).astype(np.int64)
            u = (q << k) | tail
            p = p + q + 1 + k
        v = (u >> 1) ^ -(u & 1)
        if even:
            x[place[0] + i, at] = v
        else:
            x[place + i, at] = v
    r.at[at] = p


def decode_column(media: DataFrame, column: str = "flac", keep: list[str] | None = None) -> DataFrame:
    """One row for each FLAC frame: the columns `keep` (default: all but the media), then block, sample_offset,
    n_samples, channels, sample_rate, bits, pcm (interleaved little-endian samples) and error.

    Blocks can be sought by sample_offset. All frames' checksums and the stream's MD5 are verified; what is damaged gives
    one row with `error` and no pcm, between the blocks before and after it, and never ends the job. A null stream gives
    one row of nulls; an empty one an error; a stream without frames no row. Repeated rows are decoded each; whole streams
    are, however long. No rows: no rows. Names that media already has get a leading underscore. Map-only: the streams of a
    batch, about STREAM_BYTES at a time, are decoded in step, and their blocks leave the worker in batches of about 4 MB.
    """
    keep = [c for c in media.columns if c != column] if keep is None else keep
    got = small_batches(media).select(*[F.col(f"`{c}`") for c in keep], F.col(column).alias(raw := fresh(media, "__raw")))
    kept = got.select(*[F.col(f"`{c}`") for c in keep])
    names = {n: fresh(kept, n) for n in PCM.names}
    kinds = {"int32": T.IntegerType(), "int64": T.LongType(), "binary": T.BinaryType(), "string": T.StringType()}
    schema = T.StructType([*kept.schema.fields, *[T.StructField(names[f.name], kinds[str(f.type)]) for f in PCM]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batch, rows, at):
            out = pa.RecordBatch.from_pylist(rows, schema=PCM)
            held = batch.select(keep).take(pa.array(at, pa.int64())) if keep else None
            return pa.RecordBatch.from_arrays([*(held.columns if keep else []), *out.columns], [*keep, *names.values()])

        for batch in batches:
            values, low = batch.column(raw), 0
            sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in values]
            while low < len(values):
                high, held = low, 0
                while high < len(values) and (high == low or held + sizes[high] <= STREAM_BYTES):
                    held += sizes[high]
                    high += 1
                there = [i for i in range(low, high) if values[i].is_valid]
                made = dict(zip(there, decode_many([values[i].as_py() for i in there])))
                rows, at, size = [], [], 0
                for i in range(low, high):
                    for row in made.pop(i) if i in made else [dict.fromkeys(PCM.names)]:
                        rows.append(row)
                        at.append(i)
                        size += len(row["pcm"] or b"")
                        if size > 4_000_000:
                            yield flush(batch, rows, at)
                            rows, at, size = [], [], 0
                if rows:
                    yield flush(batch, rows, at)
                low = high

    return got.mapInArrow(run, schema)


# --- encoder ---


def _put(value: int, n: int) -> np.ndarray:
    return ((value & ((1 << n) - 1)) >> np.arange(n - 1, -1, -1, dtype=object) & 1).astype(np.uint8) if n > 62 else ((np.int64(value) >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8)


def _puts(values: np.ndarray, n: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _rice_bits(x: np.ndarray, k: int) -> np.ndarray:
    u = np.where(x < 0, -2 * x - 1, 2 * x)
    q = u >> k
    ends = np.cumsum(q + 1 + k)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    stop = ends - 1 - k
    out[stop] = 1
    for i in range(k):
        out[stop + 1 + i] = u >> (k - 1 - i) & 1
    return out


def _residual_bits(x: np.ndarray, block: int, order: int) -> np.ndarray:
    parts = 2 if block % 4 == 0 and block // 4 > order else 0
    out, at = [_put(0, 2), _put(parts, 4)], 0
    for i in range(1 << parts):
        n = (block >> parts) - (order if not i else 0)
        part = x[at : at + n]
        at += n
        k = min(14, max(0, int(np.log2(max(1.0, float(np.abs(part).mean()) * 1.4)) if n else 0)))
        out += [_put(k, 4), _rice_bits(part, k)]
    return np.concatenate(out)


def _subframe_bits(x: np.ndarray, bits: int, lpc: int) -> np.ndarray:
    n = len(x)
    if (x == x[0]).all():
        return np.concatenate([_put(0, 8), _put(int(x[0]), bits)])
    any_bit = int(np.bitwise_or.reduce(x))
    wasted = (any_bit & -any_bit).bit_length() - 1
    head = np.concatenate([_put(1, 1), np.zeros(wasted - 1, np.uint8), _put(1, 1)]) if wasted else _put(0, 1)
    x, bits = x >> wasted, bits - wasted
    best, cost = 0, None
    for order in range(min(4, n - 1) + 1):
        c = np.abs(np.diff(x, order)).sum() * n / max(1, n - order)
        if cost is None or c < cost:
            best, cost = order, c
    kind, warm, extra, res = 8 + best, x[:best], np.zeros(0, np.uint8), np.diff(x, best)
    if lpc and n > 4 * lpc:
        m = np.stack([x[lpc - 1 - i : n - 1 - i] for i in range(lpc)], 1).astype(float)
        coef = np.linalg.lstsq(m, x[lpc:].astype(float), rcond=None)[0]
        top = float(np.abs(coef).max())
        shift = min(15, max(0, 13 - int(np.floor(np.log2(top)) + 1))) if top > 0 else 0
        whole = np.clip(np.round(coef * (1 << shift)), -(1 << 13), (1 << 13) - 1).astype(np.int64)
        pred = (np.stack([x[lpc - 1 - i : n - 1 - i] for i in range(lpc)], 1) @ whole) >> shift
        if np.abs(x[lpc:] - pred).sum() < cost:
            kind, warm, res = 31 + lpc, x[:lpc], x[lpc:] - pred
            extra = np.concatenate([_put(13, 4), _put(shift, 5), _puts(whole, 14)])
    body = np.concatenate([_puts(warm, bits), extra, _residual_bits(res, n, len(warm))])
    if len(body) >= n * bits:
        kind, body = 1, _puts(x, bits)
    return np.concatenate([_put(kind, 7), head, body])


def _frames_bits(x: np.ndarray, bits: int, lpc: int) -> list[bytes]:
    """_subframe_bits of each row (one channel, one length), packed to whole bytes: those that differ are coded together."""
    rows, n = x.shape
    any_bit = np.bitwise_or.reduce(x, 1)
    plain = (x != x[:, :1]).any(1) & (any_bit & 1 == 1) & (n > 16)
    out: list[bytes | None] = [None] * rows
    diffs = [np.diff(x, o, axis=1) for o in range(5)] if n > 4 else []
    if diffs and plain.any():
        cost = np.stack([np.abs(d).sum(1) * n / (n - o) for o, d in enumerate(diffs)], 1)
        kind, least = 8 + np.argmin(cost, 1), cost.min(1)
        whole, shift, res = np.zeros((rows, lpc), np.int64), np.zeros(rows, np.int64), None
        if lpc and n > 4 * lpc:
            m = np.stack([x[:, lpc - 1 - i : n - 1 - i] for i in range(lpc)], 2)
            f = m.astype(float)
            g, h = f.transpose(0, 2, 1) @ f, (f.transpose(0, 2, 1) @ x[:, lpc:, None].astype(float))
            g += np.eye(lpc) * (1e-9 * np.trace(g, axis1=1, axis2=2) + 1e-9)[:, None, None]
            coef = np.linalg.solve(g, h)[:, :, 0]
            top = np.maximum(np.abs(coef).max(1), 1e-9)
            shift = np.clip(12 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
            whole = np.clip(np.round(coef * (1 << shift)[:, None]), -(1 << 13), (1 << 13) - 1).astype(np.int64)
            res = x[:, lpc:] - ((m @ whole[:, :, None])[:, :, 0] >> shift[:, None])
            kind = np.where(np.abs(res).sum(1) < least, 31 + lpc, kind)
        for code in np.unique(kind[plain]).tolist():
            mine = np.flatnonzero(plain & (kind == code))
            order = code - 8 if code < 32 else lpc
            error = diffs[order][mine] if code < 32 else res[mine]
            parts = 2 if n % 4 == 0 and n // 4 > order else 0
            values, widths = [np.full((len(mine), 1), 2 * code), x[mine, :order]], [8, *[bits] * order]
            if code >= 32:
                values += [np.full((len(mine), 1), 13), shift[mine, None], whole[mine]]
                widths += [4, 5, *[14] * lpc]
            values.append(np.full((len(mine), 1), parts))
            sizes, low = [np.broadcast_to(np.array([*widths, 6]), (len(mine), len(widths) + 1))], 0
            for i in range(1 << parts):
                part = error[:, low : low + (n >> parts) - (order if not i else 0)]
                low += part.shape[1]
                k = np.clip(np.log2(np.maximum(1.0, np.abs(part).mean(1) * 1.4)), 0, 14).astype(np.int64)[:, None]
                u = np.where(part < 0, -2 * part - 1, 2 * part)
                values += [k, (u & (1 << k) - 1) | 1 << k]  # the zeros before the 1 are there already
                sizes += [np.full_like(k, 4), (u >> k) + 1 + k]
            value, size = np.concatenate(values, 1), np.concatenate(sizes, 1)
            total = size.sum(1)
            fits = total - 8 < n * bits
            mine, value, size, total = mine[fits], value[fits], size[fits], -(-total[fits] // 8)
            stop = np.cumsum(size, 1) + 8 * (np.cumsum(total) - total)[:, None] - 1
            packed = np.zeros(8 * int(total.sum()), np.uint8)
            shown = np.minimum(size, max(bits, 14, 15 + 1))
            for j in range(int(shown.max(initial=0))):
                on = (value >> j & 1 == 1) & (j < shown)
                packed[stop[on] - j] = 1
            raw, ends = np.packbits(packed).tobytes(), np.cumsum(total).tolist()
            for i, a, z in zip(mine.tolist(), [0, *ends[:-1]], ends):
                out[i] = raw[a:z]
    return [np.packbits(_subframe_bits(v, bits, lpc)).tobytes() if got is None else got for v, got in zip(x, out)]


def encode_many(signals: list[np.ndarray], rate: int = 16000, bits: int = 16, block: int = 4096, lpc: int = 0) -> list[bytes]:
    """encode of each signal of one channel, with frames of one length coded together."""
    at, places = {}, {}
    for i, x in enumerate(signals):
        for j, low in enumerate(range(0, len(x), block)):
            part = x[low : low + block]
            at.setdefault(len(part), []).append(part)
            places.setdefault(len(part), []).append((i, j))
    made = {}
    for n, parts in at.items():
        made |= dict(zip(places[n], _frames_bits(np.stack(parts), bits, lpc)))
    out = []
    for i, x in enumerate(signals):
        frames = [_framed(_frame_head(j, min(block, len(x) - low), 0, bits), made[i, j]) for j, low in enumerate(range(0, len(x), block))]
        out.append(b"".join([_stream_head(x[:, None], rate, bits, block), *frames]))
    return out


def _number(v: int) -> bytes:
    if v < 128:
        return bytes([v])
    n = next(i for i in range(2, 8) if v < 1 << (5 * i + 1))
    tail = [0x80 | v >> 6 * i & 0x3F for i in range(n - 1)][::-1]
    return bytes([(0xFF00 >> n & 0xFF) | v >> 6 * (n - 1), *tail])


def encode(x: np.ndarray, rate: int = 16000, bits: int = 16, block: int = 4096, lpc: int = 0, stereo: str = "independent") -> bytes:
    """A FLAC stream of samples (n x channels). stereo: independent, left, right or mid (side channels of two)."""
    x = (x if x.ndim == 2 else x[:, None]).astype(np.int64)
    channels = x.shape[1]
    out = [_stream_head(x, rate, bits, block)]
    for i, low in enumerate(range(0, len(x), block)):
        part = x[low : low + block]
        left, right = part[:, 0], part[:, -1]
        mode, lanes = {"left": (8, [left, left - right]), "right": (9, [left - right, right]), "mid": (10, [(left + right) >> 1, left - right])}.get(stereo if channels == 2 else "", (channels - 1, list(part.T)))
        side = _SIDE.get(mode, -1)
        out.append(_framed(_frame_head(i, len(part), mode, bits), np.packbits(np.concatenate([_subframe_bits(v, bits + (c == side), lpc) for c, v in enumerate(lanes)])).tobytes()))
    return b"".join(out)


def _stream_head(x: np.ndarray, rate: int, bits: int, block: int) -> bytes:
    info = (rate << 44 | (x.shape[1] - 1) << 41 | (bits - 1) << 36 | len(x)).to_bytes(8, "big")
    return b"fLaC\x80\x00\x00\x22" + block.to_bytes(2, "big") * 2 + bytes(6) + info + hashlib.md5(pcm_bytes(x, bits)).digest()


def _frame_head(i: int, n: int, mode: int, bits: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x70, mode << 4 | _CODES.get(bits, 0) << 1]) + _number(i) + (n - 1).to_bytes(2, "big")
    return head + bytes([CRC8.of_few(list(head))])


def _framed(head: bytes, body: bytes) -> bytes:
    return head + body + CRC16(np.frombuffer(head + body, np.uint8)).to_bytes(2, "big")


def vectors_as_media(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", stretch: int = 8, block: int = 256) -> DataFrame:
    """(key, flac): each vector as a 16-bit mono signal, `stretch` samples from each component to the next; null stays null.

    There is no media table; this makes one of a table of vectors. Components that aren't finite count as 0, and so do
    null ones; the largest becomes 30,000.
    """

    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[bytes | None] = [None] * len(part)
            for low in range(0, len(part), 2000):
                signals = {i: _signal(v, stretch) for i, v in enumerate(part[low : low + 2000], low) if v is not None}
                for lpc in (6, 0):  # by turns
                    mine = [i for i in signals if i % 2 == (lpc == 0)]
                    for i, raw in zip(mine, encode_many([signals[i] for i in mine], block=block, lpc=lpc)):
                        out[i] = raw
            yield pd.Series(out)

    return vectors.select(F.col(key), F.pandas_udf(make, "binary")(F.col(column).cast("array<double>")).alias("flac"))


def _signal(v: np.ndarray, stretch: int) -> np.ndarray:
    y = np.nan_to_num(np.array(v, float), posinf=0, neginf=0)
    if len(y):
        y = np.interp(np.arange(len(y) * stretch) / stretch, np.arange(len(y)), y)
        y = np.round(y * (30000 / max(1e-9, float(np.abs(y).max()))))
    return y.astype(np.int64)
