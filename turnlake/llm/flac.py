"""FLAC columns: lossless coding of sample bytes, verified decoding, and PCM blocks with seekable sample offsets.

Streams written here are mono, 8 bits a sample, with a seek point for every frame, so that the frames of many streams are decoded
side by side: one numpy lane for each frame, stepping through Rice residuals and linear predictors together. Mono streams of other
encoders, with any block sizes, partitions, Rice and escape codes and without seek points, are decoded frame by frame. Every
frame is verified by its header's CRC-8 and its CRC-16 and every stream by the MD5 of its samples, where it has one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1024  # samples of a frame
BATCH = 1_500_000  # samples coded at a time in one task
RATE = 8000
LPC_ORDER, PRECISION = 4, 12
#: Fixed values of the format: linear predictors of the fixed subframes by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def crc_table(width: int, poly: int) -> np.ndarray:
    """Remainders of single bytes by a polynomial of this many bits."""
    rest = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        rest = np.where(rest >> (width - 1) & 1, rest << 1 ^ poly, rest << 1) & ((1 << width) - 1)
    return rest


class Crc:
    """Checksums of many byte ranges at once: the sum of each byte's remainder at its distance from the end."""

    def __init__(self, width: int, poly: int):
        self.one, self.width = crc_table(width, poly), width
        self.by_distance = self.one[None, :].copy()

    def grow(self, n: int) -> None:
        have, mask = [self.by_distance], (1 << self.width) - 1
        last = self.by_distance[-1]
        for _ in range(n - len(self.by_distance)):
            last = (last << 8 & mask) ^ self.one[last >> (self.width - 8)]
            have.append(last[None, :])
        self.by_distance = np.concatenate(have)

    def of(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0, np.int64)
        self.grow(int(size.max()))
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        parts = self.by_distance[np.repeat(size, size) - 1 - inside, data[np.repeat(first, size) + inside]]
        return np.bitwise_xor.reduceat(parts, ends - size)


CRC8, CRC16 = Crc(8, 0x07), Crc(16, 0x8005)


def utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def quantised_lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictor coefficients of each row (Levinson-Durbin) as integers of PRECISION bits, and their shifts."""
    x = x.astype(np.float64) * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(x[:, k:] * x[:, : x.shape[1] - k]).sum(axis=1) for k in range(order + 1)])
    a, err = np.zeros((order, len(x))), r[0] + 1e-9
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(np.abs(a).max(axis=0), 2.0**-14))).astype(np.int64), 0, 14)
    bound = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -bound, bound).astype(np.int64), shift


def rice_parameter(folded: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest Rice parameter of each row near the logarithm of its mean residual, and its bits. Unused cells hold 0."""
    near = np.floor(np.log2(np.maximum(total / np.maximum(n, 1), 1))).astype(np.int32)
    tries = np.clip(np.stack([near - 1, near, near + 1]), 0, 14)
    bits = np.stack([(folded >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k + 1) for k in tries])
    best, row = bits.argmin(axis=0), np.arange(len(n))
    return tries[best, row], bits[best, row]


def put(sums: list[np.ndarray], at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Add numbers of up to 16 bits at bit positions; each touches three bytes, and no two share a bit."""
    shifted = value << (24 - (at & 7) - width)
    byte = at >> 3
    for k in range(3):
        sums[0] += np.bincount(byte + k, shifted >> (16 - 8 * k) & 255, len(sums[0]))


def encode_frames(samples: list[np.ndarray]) -> list[list[bytes]]:
    """Frames of each stream; every frame takes the cheapest of constant, verbatim, fixed and LPC subframes."""
    blocks = [(s, k) for s, x in enumerate(samples) for k in range(-(-len(x) // BLOCK))]
    out: list[list[bytes]] = [[] for _ in samples]
    if not blocks:
        return out
    size = np.array([min(BLOCK, len(samples[s]) - k * BLOCK) for s, k in blocks])
    x = np.zeros((len(blocks), BLOCK), np.int32)
    for row, (s, k), n in zip(x, blocks, size, strict=True):
        row[:n] = samples[s][k * BLOCK : k * BLOCK + n]
    inside = np.arange(BLOCK) < size[:, None]
    # the predictor with the least sum of absolute residuals, then its Rice parameter
    best = np.full(len(blocks), 1 << 60)
    order, lpc = np.zeros((2, len(blocks)), np.int64)
    residual = np.zeros_like(x)

    def offer(p: int, d: np.ndarray, is_lpc: int, extra: int) -> None:
        total = np.abs(d[:, p:]).sum(axis=1, where=inside[:, p:], dtype=np.int64) + extra
        wins = (total < best) & (size > p)
        best[wins], order[wins], lpc[wins] = total[wins], p, is_lpc
        residual[wins] = d[wins]

    d = x
    for p in range(5):
        if p:
            d = np.diff(d, axis=1, prepend=np.int32(0))
        offer(p, d, 0, 0)
    coefs, shift = quantised_lpc(x, LPC_ORDER)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, j + 1 :] += coefs[j][:, None].astype(np.int32) * x[:, : BLOCK - 1 - j]
    offer(LPC_ORDER, x - (guess >> shift[:, None].astype(np.int32)), 1, 200)
    used = inside.copy()
    for p in range(4):
        used[:, p] &= order <= p
    folded = np.where(used, residual << 1 ^ residual >> 31, 0)
    rice, bits = rice_parameter(folded, folded.sum(axis=1, dtype=np.int64), size - order)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits + 8 * order + lpc * (9 + PRECISION * LPC_ORDER) + 10 >= 8 * size)
    coded = ~constant & ~verbatim
    kind = np.select([constant, verbatim, lpc == 1], [0, 1, 31 + order], 8 + order)
    # headers: sync, fixed block size; size code 7 with 16 bits for the block size; rate from STREAMINFO; mono; 8 bits
    heads = []
    for (_, k), n in zip(blocks, size.tolist(), strict=True):
        heads.append(b"\xff\xf8\x70\x02" + utf8_number(k) + (n - 1).to_bytes(2, "big"))
    head_size = np.array([len(h) for h in heads])
    head_first = np.cumsum(head_size) - head_size
    crc8 = CRC8.of(np.frombuffer(b"".join(heads), np.uint8), head_first, head_size)
    # bits after the header: subframe header 8, warm-up 8 each, for LPC 9 and the coefficients, 6 + 4 for the residual's header
    warm = np.where(coded, order, 0)
    used &= coded[:, None]
    quotient = folded >> rice[:, None].astype(np.int32)
    width = np.where(used, quotient + 1 + rice[:, None].astype(np.int32), 0)
    fixed_part = 8 + np.select([constant, verbatim], [8, 8 * size], 8 * warm + np.where(lpc == 1, 9 + PRECISION * LPC_ORDER, 0) + 10)
    body = -(-(fixed_part + width.sum(axis=1, dtype=np.int64)) // 8)
    frame_size = head_size + 1 + body + 2
    first = np.cumsum(frame_size) - frame_size
    sums = [np.zeros(int(frame_size.sum()) + 3)]
    at = 8 * (first + head_size + 1)
    put(sums, at, kind << 1, 8)
    put(sums, at[constant] + 8, x[constant, 0].astype(np.int64) & 255, 8)
    if verbatim.any():
        r, c = np.nonzero(inside & verbatim[:, None])
        put(sums, at[r] + 8 + 8 * c, x[r, c].astype(np.int64) & 255, 8)
    at = at + 8
    for p in range(4):
        on = coded & (warm > p)
        put(sums, at[on] + 8 * p, x[on, p].astype(np.int64) & 255, 8)
    at = at + 8 * warm
    on = coded & (lpc == 1)
    put(sums, at[on], np.full(on.sum(), PRECISION - 1), 4)
    put(sums, at[on] + 4, shift[on], 5)
    for j in range(LPC_ORDER):
        put(sums, at[on] + 9 + PRECISION * j, coefs[j][on] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(on, 9 + PRECISION * LPC_ORDER, 0)
    put(sums, at[coded] + 6, rice[coded].astype(np.int64), 4)
    start = (at + 10)[:, None] + (np.cumsum(width, axis=1, dtype=np.int32) - width + quotient)
    k = np.repeat(rice, used.sum(axis=1))
    put(sums, start[used], (1 << k) | folded[used] & ((1 << k) - 1), k + 1)  # the stop bit and the remainder
    data = sums[0][:-3].astype(np.uint8)
    all_heads = np.frombuffer(b"".join(heads), np.uint8)
    spread = np.arange(len(all_heads)) - np.repeat(head_first, head_size)
    data[np.repeat(first, head_size) + spread] = all_heads
    data[first + head_size] = crc8
    crc16 = CRC16.of(data, first, frame_size - 2)
    data[first + frame_size - 2], data[first + frame_size - 1] = crc16 >> 8, crc16 & 255
    whole = data.tobytes()
    for (s, _), f, n in zip(blocks, first.tolist(), frame_size.tolist(), strict=True):
        out[s].append(whole[f : f + n])
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of the payloads' bytes as signed 8-bit samples (byte - 128)."""
    signed = [(np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8) for p in payloads]
    out = []
    for x, frames in zip(signed, encode_frames([s.astype(np.int64) for s in signed]), strict=True):
        sizes = [len(f) for f in frames] or [0]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
        points, at = [], 0
        for k, f in enumerate(frames):
            points.append((k * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(x) - k * BLOCK).to_bytes(2, "big"))
            at += len(f)
        # a metadata block holds 2**24 - 1 bytes at most; longer streams get several seek tables
        tables = [points[i : i + 900_000] for i in range(0, len(points), 900_000)] or [[]]
        blocks = [b"\x00" + len(info).to_bytes(3, "big") + info]
        for k, t in enumerate(tables):
            blocks.append(bytes([3 | 0x80 * (k == len(tables) - 1)]) + (18 * len(t)).to_bytes(3, "big") + b"".join(t))
        out.append(b"fLaC" + b"".join(blocks) + b"".join(frames))
    return out


class Damaged(ValueError):
    """A stream that is no valid FLAC, or not of the kind written here."""


def stream_parts(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Number of samples, MD5, seek points (first sample, byte offset, samples) and where the frames begin."""
    if media[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, points, last, info = 4, [], False, b""
    while not last:
        if at + 4 > len(media):
            raise Damaged("metadata cut short")
        last, kind, size = media[at] >> 7 == 1, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        own = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = own
        elif kind == 3:
            points += [(int.from_bytes(own[i : i + 8], "big"), int.from_bytes(own[i + 8 : i + 16], "big"), int.from_bytes(own[i + 16 : i + 18], "big")) for i in range(0, len(own), 18)]
        at += 4 + size
    if len(info) != 34:
        raise Damaged("no stream info")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise Damaged("not mono, 8 bits")
    n = packed & ((1 << 36) - 1)
    points = [p for p in points if p[0] != (1 << 64) - 1]
    return n, info[18:], points, at


def get(words: np.ndarray, at: np.ndarray, width: np.ndarray | int, signed: bool = False) -> np.ndarray:
    """Numbers of up to 16 bits at bit positions; words[i] holds the 24 bits from byte i on."""
    out = words[at >> 3] >> (24 - (at & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)
    return np.where(out >> (np.maximum(width, 1) - 1) & 1, out - (1 << np.asarray(width, np.int64)), out) if signed else out


#: Zero bits before the first set one of 16; 16 if there is none.
LEADING = np.full(1 << 16, 16, np.int64)
for _k in range(16):
    LEADING[1 << _k : 2 << _k] = 15 - _k


def decode_own(streams: list[bytes]) -> list[np.ndarray | Damaged]:
    """Samples of each stream of this module's form, or why it isn't one. Frames of all streams are decoded side by side."""
    found: list[np.ndarray | Damaged] = []
    parts, first, size, count, number, owner, at = [], [], [], [], [], [], 0
    sums: list[bytes] = []
    for s, media in enumerate(streams):
        sums.append(b"")
        try:
            n, sums[s], points, begin = stream_parts(media)
            if sum(p[2] for p in points) != n:
                raise Damaged("seek points don't cover the samples")
        except Damaged as e:
            found.append(e)
            continue
        found.append(np.zeros(n, np.int8))
        ends = [p[1] for p in points[1:]] + [len(media) - begin] * bool(points)
        for k, (p, end) in enumerate(zip(points, ends, strict=True)):
            first.append(at + begin + p[1])
            size.append(end - p[1])
            count.append(p[2])
            number.append(k)
            owner.append(s)
        parts.append(media)
        at += len(media)
    if not first:
        return found
    data = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
    first, size, count, owner = (np.array(v, np.int64) for v in (first, size, count, owner))
    wrong = (size < 9) | (first + size > at)
    first, size = np.where(wrong, 0, first), np.where(wrong, 9, size)
    # headers
    wrong |= (data[first] != 0xFF) | (data[first + 1] != 0xF8) | (data[first + 2] != 0x70) | (data[first + 3] != 0x02)
    lead = data[first + 4].astype(np.int64)
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    value = np.where(extra == 0, lead, lead & (0x3F >> extra))
    for j in range(int(extra.max())):
        value = np.where(j < extra, value << 6 | data[first + 5 + np.minimum(j, extra)] & 0x3F, value)
    head = 5 + extra + 2
    blocksize = (data[first + head - 2].astype(np.int64) << 8 | data[first + head - 1]) + 1
    wrong |= (value != np.array(number)) | (blocksize != count)
    wrong |= CRC8.of(data, first, head) != data[first + head]
    wrong |= CRC16.of(data, first, size - 2) != (data[first + size - 2].astype(np.int64) << 8 | data[first + size - 1])
    keep = np.flatnonzero(~wrong)
    keep = keep[np.argsort(-count[keep], kind="stable")]  # lanes of long frames first: those still running are a prefix
    for s in np.unique(owner[wrong]):
        found[s] = Damaged("a frame's checksum or header is wrong")
    if len(keep):
        wide = data.astype(np.int64)
        bits = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
        lanes = 8 * (first + head + 1)[keep]
        values = decode_subframes(bits, lanes, count[keep], 8 * (first + size - 2)[keep])
        place = {s: np.zeros(len(x), np.int8) for s, x in enumerate(found) if not isinstance(x, Damaged)}
        start = np.array(number, np.int64)  # frames before this one of its stream hold BLOCK samples each, or the seek point says
        offset = np.concatenate([[0], np.cumsum(count)[:-1]])
        stream_first = np.full(len(streams), 1 << 60)
        np.minimum.at(stream_first, owner, offset)
        start = offset - stream_first[owner]
        for lane, f in enumerate(keep.tolist()):
            if (s := int(owner[f])) in place:
                place[s][start[f] : start[f] + count[f]] = values[lane, : count[f]]
        for s, x in place.items():
            found[s] = x if hashlib.md5(x.tobytes()).digest() == sums[s] else Damaged("the MD5 of the samples is wrong")
    return found


def decode_subframes(words: np.ndarray, at: np.ndarray, count: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Samples of each lane's subframe. at: first bits; end: bits after the last; lanes run from long to short."""
    kind = get(words, at, 8) >> 1
    at = at + 8
    out = np.zeros((len(at), int(count.max())), np.int8)
    constant, verbatim, is_fixed, is_lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    out[constant] = get(words, at[constant], 8, signed=True)[:, None]
    for lane in np.flatnonzero(verbatim):
        out[lane, : count[lane]] = get(words, at[lane] + 8 * np.arange(count[lane]), 8, signed=True)
    on = np.flatnonzero(is_fixed | is_lpc)
    if len(on):
        out[on] = decode_predicted(words, at[on], count[on], end[on], np.where(is_lpc, kind - 31, kind - 8)[on], is_lpc[on], out.shape[1])
    return out


def decode_predicted(words: np.ndarray, at: np.ndarray, count: np.ndarray, end: np.ndarray, order: np.ndarray, is_lpc: np.ndarray, steps: int) -> np.ndarray:
    """Samples of fixed and LPC subframes: all lanes read one Rice code and add their prediction at each step."""
    top, last = int(order.max()), len(words) - 1
    history = np.zeros((steps, len(at)), np.int64)
    for p in range(top):
        history[p] = np.where(order > p, get(words, at + 8 * p, 8, signed=True), 0)
    at = at + 8 * order
    coefs, shift = np.zeros((top, len(at)), np.int64), np.zeros(len(at), np.int64)
    for p, values in enumerate(FIXED):
        for j, c in enumerate(values):
            if j < top:
                coefs[j, ~is_lpc & (order == p)] = c
    on = np.flatnonzero(is_lpc)
    if len(on):
        precision = get(words, at[on], 4) + 1
        shift[on] = get(words, at[on] + 4, 5)
        for j in range(int(order[on].max())):
            has = on[order[on] > j]
            own = precision[order[on] > j]
            coefs[j, has] = get(words, at[has] + 9 + own * j, own, signed=True)
        at[on] += 9 + precision * order[on]
    # the residual's header: 2 bits coding method, 4 bits partition order (both 0 in this module's form), 4 bits Rice parameter
    rice = get(words, at + 6, 4)
    end = np.where((get(words, at, 6) != 0) | (rice == 15), -1, end)  # another encoder's: not to be decoded here
    at = at + 10
    mask, room = (1 << rice) - 1, 24 - rice
    alive = np.searchsorted(-count, -np.arange(steps), side="left")  # lanes with more than t samples come first
    for t in range(steps):
        n = int(alive[t])
        p = at[:n]
        q = LEADING[words[p >> 3] >> (8 - (p & 7)) & 0xFFFF]
        if (q == 16).any():  # a long run of zeros: go on where it is open
            open_ = np.flatnonzero(q == 16)
            while len(open_):
                here = np.minimum(p[open_] + q[open_], 8 * last)
                more = LEADING[words[here >> 3] >> (8 - (here & 7)) & 0xFFFF]
                q[open_] += more
                open_ = open_[(more == 16) & (q[open_] < 1 << 16)]
        after = p + q + 1
        folded = q << rice[:n] | words[np.minimum(after >> 3, last)] >> (room[:n] - (after & 7)) & mask[:n]
        value = folded >> 1 ^ -(folded & 1)
        after += rice[:n]
        if top:
            guess = np.zeros(n, np.int64)
            for j in range(min(top, t)):
                guess += coefs[j, :n] * history[t - 1 - j, :n]
            value += guess >> shift[:n]
        if t < top:
            warm = order[:n] > t
            value, after = np.where(warm, history[t, :n], value), np.where(warm, p, after)
        history[t, :n] = value
        at[:n] = np.minimum(after, 8 * last)
    history[:, at > end] = 0  # read past its frame: the stream's MD5 tells
    return history.T.astype(np.int8)


class Bits:
    """Reads numbers of the bits of a stream from a position on."""

    def __init__(self, data: bytes, first: int):
        self.data, self.at = data, 8 * first

    def take(self, width: int, signed: bool = False) -> int:
        if not width:
            return 0
        lo, end = self.at >> 3, self.at + width
        if end > 8 * len(self.data):
            raise Damaged("the stream is cut short")
        value = int.from_bytes(self.data[lo : -(-end // 8)], "big") >> (-end % 8) & ((1 << width) - 1)
        self.at = end
        return value - (1 << width) if signed and value >> (width - 1) else value

    def zeros(self) -> int:
        """Zero bits before the next set one, which is passed too."""
        n = 0
        while True:
            left = 8 - (self.at & 7)
            if self.at >> 3 >= len(self.data):
                raise Damaged("the stream is cut short")
            here = self.data[self.at >> 3] & ((1 << left) - 1)
            if here:
                k = left - here.bit_length()
                self.at += k + 1
                return n + k
            self.at += left
            n += left


def residuals(bits: Bits, size: int, order: int) -> list[int]:
    """The residuals of a subframe: partitions of Rice codes with parameters of 4 or 5 bits, or of plain numbers behind an escape code."""
    wide, parts = bits.take(2), 1 << bits.take(4)
    if wide > 1 or size % parts or size // parts < order:
        raise Damaged("a residual's header is wrong")
    width, out = 4 + wide, []
    for k in range(parts):
        rice, n = bits.take(width), size // parts - (order if k == 0 else 0)
        if rice == (1 << width) - 1:
            plain = bits.take(5)
            out += [bits.take(plain, signed=True) for _ in range(n)]
            continue
        for _ in range(n):
            folded = bits.zeros() << rice | bits.take(rice)
            out.append(folded >> 1 ^ -(folded & 1))
    return out


def subframe(bits: Bits, size: int, depth: int) -> list[int]:
    """The samples of one subframe of any kind."""
    if bits.take(1):
        raise Damaged("a subframe's header is wrong")
    kind, wasted = bits.take(6), bits.zeros() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.take(depth, signed=True)] * size
    elif kind == 1:
        out = [bits.take(depth, signed=True) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        if order > size:
            raise Damaged("a predictor's order is larger than its block")
        out = [bits.take(depth, signed=True) for _ in range(order)]
        coefs, shift = FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.take(5, signed=True)
            if precision == 16 or shift < 0:
                raise Damaged("a predictor's header is wrong")
            coefs = [bits.take(precision, signed=True) for _ in range(order)]
        for r in residuals(bits, size, order):
            out.append(r + (sum(c * x for c, x in zip(coefs, reversed(out), strict=False)) >> shift))
    else:
        raise Damaged("an unknown kind of subframe")
    return [x << wasted for x in out]


def decode_any(media: bytes) -> np.ndarray:
    """Samples of one mono stream of 8 bits of any encoder, decoded frame by frame; raises Damaged."""
    n, md5, points, begin = stream_parts(media)
    at, frames = begin, set()
    out: list[int] = []
    while len(out) < n:
        first, bits = at, Bits(media, at)
        if bits.take(15) != 0x7FFC:
            raise Damaged("no frame where one should begin")
        bits.take(1)
        code, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        if code == 0 or rate == 15 or channels or depth not in (0, 1):
            raise Damaged("not mono, 8 bits")
        lead = bits.take(8)
        bits.take(8 * max(0, 7 - (~lead & 0xFF).bit_length() if lead >= 0xC0 else 0))
        size = 192 if code == 1 else 144 << code if code <= 5 else bits.take(8 * (code - 5)) + 1 if code <= 7 else 1 << code
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        end = bits.at >> 3
        if bits.take(8) != int(CRC8.of(np.frombuffer(media[first:end], np.uint8), np.array([0]), np.array([end - first]))[0]):
            raise Damaged("a frame's header has a wrong checksum")
        out += subframe(bits, size, 8)
        end = -(-bits.at // 8)
        if media[end : end + 2] != int(CRC16.of(np.frombuffer(media[first:end], np.uint8), np.array([0]), np.array([end - first]))[0]).to_bytes(2, "big"):
            raise Damaged("a frame's checksum is wrong")
        at = end + 2
        frames.add((len(out) - size, first - begin, size))
    if not frames.issuperset(points):
        raise Damaged("a seek point is wrong")
    x = np.array(out, np.int64)
    if len(x) != n or (n and (x.min() < -128 or x.max() > 127)):
        raise Damaged("the samples don't fit the stream's header")
    x = x.astype(np.int8)
    if any(md5) and hashlib.md5(x.tobytes()).digest() != md5:
        raise Damaged("the MD5 of the samples is wrong")
    return x


def decode(streams: list[bytes]) -> list[np.ndarray | Damaged]:
    """Samples of each stream (signed 8-bit), or what is wrong with it: side by side where the stream has this module's form, else frame by frame."""
    found = decode_own(streams)
    for s, x in enumerate(found):
        if isinstance(x, Damaged) and streams[s][:4] == b"fLaC":
            try:
                found[s] = decode_any(streams[s])
            except Damaged as e:
                found[s] = e
    return found


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def in_batches(items: list[bytes]) -> Iterator[slice]:
    """Ranges of items of about BATCH bytes together; a longer item makes a range of its own."""
    lo = total = 0
    for k, x in enumerate(items):
        if total and total + len(x) > BATCH:
            yield slice(lo, k)
            lo, total = k, 0
        total += len(x)
    if items:
        yield slice(lo, len(items))


@F.pandas_udf(T.BinaryType())
def store(text: pd.Series) -> pd.Series:
    """The FLAC stream of each text's payload; a null text counts as empty."""
    data = [payload(t) for t in text]
    return pd.Series([m for part in in_batches(data) for m in encode(data[part])], dtype=object)


DIGEST = T.StructType([T.StructField(n, T.StringType() if "sha" in n or n == "feature" else T.LongType()) for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks", "last_sample")])
PCM_BLOCK = 4096  # samples of a PCM block


def pcm(x: np.ndarray, block: int) -> Iterator[tuple[int, bytes]]:
    """PCM blocks of samples: the first sample's number and unsigned bytes of each."""
    data = (x.view(np.uint8) ^ 0x80).tobytes()
    return ((i, data[i : i + block]) for i in range(0, len(data), block))


def features(x: np.ndarray) -> str:
    """Whole-number features of samples: mean, energy, sign changes, peak and a 16-bin histogram."""
    v = x.astype(np.int64)
    bins = np.bincount((v + 128) >> 4, minlength=16)
    return f"mean={int(v.sum() * 1000 // len(v))};energy={int((v * v).sum() // len(v))};zc={int(((v[1:] >= 0) != (v[:-1] >= 0)).sum())};peak={int(np.abs(v).max())};hist=" + "-".join(map(str, bins.tolist()))


@F.pandas_udf(DIGEST)
def digest(media: pd.Series) -> pd.DataFrame:
    """What the stored bytes hold once decoded, verified and cut into PCM blocks, with the number of blocks and the first sample of the last.

    A damaged stream has its size and sum and the reason as feature; the rest is null.
    """
    rows, streams = [], list(media)
    for part in in_batches(streams):
        for m, x in zip(streams[part], decode(streams[part]), strict=True):
            size, sha = len(m), hashlib.sha256(m).hexdigest()
            if isinstance(x, Damaged):
                rows.append((None, None, None, size, sha, f"damaged: {x}", None, None))
                continue
            total, n, last, tail = hashlib.sha256(), 0, None, b""
            for last, data in pcm(x, PCM_BLOCK):
                total.update(data)
                tail, n = (tail + data)[-64:], n + 1
            rows.append((len(x), total.hexdigest(), zlib.crc32(tail), size, sha, features(x), n, last))
    out = pd.DataFrame(rows, columns=DIGEST.names)
    return out.astype({f.name: "Int64" for f in DIGEST if f.dataType == T.LongType()})


def with_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """docs with the FLAC stream of each text's padded UTF-8 bytes; null counts as empty; a column of that name is replaced.

    Very long texts are one stream of many frames. Equal texts give equal streams (ties), repeated rows each their own; an
    empty table gives an empty one; other columns stay as they are.
    """
    return docs.withColumn(into, store(F.col(text)))


def pcm_blocks(media: DataFrame, key: str, column: str = "media", block: int = PCM_BLOCK) -> DataFrame:
    """PCM blocks of the streams: key, block_no, first_sample, n_samples, pcm (unsigned bytes), error.

    first_sample makes the blocks seekable. A damaged stream gives one row with its error and no samples; a null
    stream counts as damaged, one without samples gives no row. Rows with equal keys each give their own blocks.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = [m or b"" for m in batch["m"]]
            for part in in_batches(streams):
                rows = []
                for k, x in zip(batch["k"].iloc[part], decode(streams[part]), strict=True):
                    if isinstance(x, Damaged):
                        rows.append((k, 0, 0, 0, None, str(x)))
                        continue
                    rows += [(k, i // block, i, len(data), data, None) for i, data in pcm(x, block)]
                yield pd.DataFrame(rows, columns=[key, "block_no", "first_sample", "n_samples", "pcm", "error"])

    schema = f"`{key}` {kind}, block_no bigint, first_sample bigint, n_samples bigint, pcm binary, error string"
    return media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(store("text")).alias("_d"))
    return read.select("doc_id", "n_bytes", "_d.*")
