"""FLAC columns: 8-bit mono samples, all frames of a batch coded and decoded side by side.

The stream format is public (RFC 9639). A step of every loop below handles one sample, or one byte, of all frames.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 1152, 8000
ORDER, PRECISION, SHIFT = 4, 13, 10  # of the coder's linear predictor
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, full = 1 << bits - 1, (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & full
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each slice of ``data``, one byte of all slices at a time."""
    order = np.argsort(-lengths, kind="stable")
    at, n, crc = starts[order], lengths[order], np.zeros(len(starts), np.int64)
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    for i, m in enumerate(live.tolist()):
        byte = data[at[:m] + i]
        crc[:m] = table[byte] if bits == 8 and i == 0 else (crc[:m] << 8 & (1 << bits) - 1) ^ table[crc[:m] >> bits - 8 ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """``x`` (samples, frames) less its prediction by ``coefficients`` (order, frames)."""
    guess = np.zeros_like(x)
    for j, c in enumerate(coefficients):
        guess[j + 1 :] += c * x[: -j - 1]
    return x - (guess >> shift)


def _linear(x: np.ndarray, order: int) -> np.ndarray:
    """Quantized coefficients by Levinson-Durbin for all frames."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->j", f[k:], f[: len(f) - k]) for k in range(order + 1)]).astype(np.float64)
    a, err = np.zeros((order, x.shape[1])), np.maximum(r[0], 1e-9)
    for i in range(order):
        k = (r[i + 1] - (a[:i] * r[1 : i + 1][::-1]).sum(axis=0)) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top).astype(np.int32)


def encode(payloads: Sequence[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload (nonempty), with a seek point for every frame."""
    sizes = np.array([len(p) for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    frames = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    n = np.minimum(block, sizes[doc] - number * block)
    begin = (np.cumsum(sizes) - sizes)[doc] + number * block
    step = np.arange(n.max())
    valid = step[:, None] < n
    x = np.where(valid, flat[np.minimum(begin + step[:, None], len(flat) - 1)].astype(np.int32) - 128, 0)
    linear = _linear(x, ORDER)
    best = None
    for kind, order, coefficients, shift in ((8, 0, (), 0), (9, 1, [np.int32(1)], 0), (32 + ORDER - 1, ORDER, linear, SHIFT)):
        e = _residual(x, coefficients, shift)
        u = (e << 1) ^ (e >> 31)
        u[~valid] = 0
        u[:order] = 0
        coded = np.maximum(n - order, 1)
        k = np.clip(np.log2(np.maximum(u.sum(axis=0) / coded * 0.7, 1)).astype(np.int32), 0, 14)
        bits = coded * (k + 1) + (u >> k).sum(axis=0) + 8 * order + (order * PRECISION + 9 if kind >= 32 else 0) + 10
        if best is None:
            best = [bits, np.full(len(n), kind), np.full(len(n), order), k, u]
        else:
            won = bits < best[0]
            for i, new in enumerate((bits, kind, order, k)):
                best[i] = np.where(won, new, best[i])
            best[4][:, won] = u[:, won]
    bits, kind, order, k, u = best
    plain, same = bits >= 8 * n, (np.where(valid, x, x[0]) == x[0]).all(axis=0)
    plain &= ~same | (order > n)
    kind = np.where(same, 0, np.where(plain, 1, kind))
    coded = kind >= 8
    order = np.where(coded, order, 0)
    # lengths, then places, of all fields in bits
    digits = 1 + (number >= 0x80) + (number >= 0x800) + (number >= 0x10000)
    code = np.select([n == 192, n == 576, n == 1152], [1, 2, 3], 7)
    head = 4 + digits + np.where(code == 7, 2, 0) + 1
    quotient = u >> k
    widths = np.where(coded & valid & (step[:, None] >= order), quotient + 1 + k, 0)
    prefix = 8 + np.where(coded, 8 * order + np.where(kind >= 32, 9 + PRECISION * order, 0) + 10, 0)
    ends = np.cumsum(widths, axis=0)
    body = prefix + np.where(coded, ends[-1], np.where(same, 8, 8 * n))
    length = head + -(-body // 8) + 2
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) * 8, np.uint8)

    def put(at: np.ndarray, value, width: int) -> None:
        for j in range(width):
            out[at + (width - 1 - j)] = (value >> j) & 1

    at = start * 8
    put(at, np.full(len(n), 0xFFF8), 16)
    put(at + 16, code << 12 | 0x02, 16)
    put(at + 32, np.select([digits == 1, digits == 2, digits == 3], [number, 0xC0 | number >> 6, 0xE0 | number >> 12], 0xF0 | number >> 18), 8)
    for d in (2, 3, 4):
        on = digits >= d
        put(at[on] + 24 + 8 * d, 0x80 | number[on] >> 6 * (digits[on] - d) & 0x3F, 8)
    on = code == 7
    put(at[on] + 32 + 8 * digits[on], n[on] - 1, 16)
    at = at + 8 * head
    put(at, kind << 1, 8)
    at = at + 8
    put(at[same], x[0][same] & 0xFF, 8)
    for f in np.flatnonzero(plain).tolist():
        out[at[f] : at[f] + 8 * n[f]] = np.unpackbits((x[: n[f], f] & 0xFF).astype(np.uint8))
    for j in range(int(order.max())):
        on = order > j
        put(at[on] + 8 * j, x[j][on] & 0xFF, 8)
    at = at + 8 * order
    on = kind >= 32
    put(at[on], np.full(on.sum(), PRECISION - 1 << 5 | SHIFT), 9)
    for j in range(ORDER):
        put(at[on] + 9 + PRECISION * j, linear[j][on] & (1 << PRECISION) - 1, PRECISION)
    at = np.where(on, at + 9 + PRECISION * order, at)
    put(at[coded], k[coded], 10)  # method 0, partition order 0, the Rice parameter
    # a code ends in a one and the low bits; the zeros before it are there already
    codes = np.flatnonzero((widths > 0).ravel())
    last = (ends + (at + 10)).ravel()[codes]
    low, wide = (1 << k | u & (1 << k) - 1).ravel()[codes], np.broadcast_to(k + 1, u.shape).ravel()[codes]
    for j in range(int(k.max(initial=0)) + 1):
        on = wide > j
        if on.all():
            out[last - 1 - j] = low >> j & 1
        else:
            out[last[on] - 1 - j] = low[on] >> j & 1
    data = np.packbits(out)
    data[start + head - 1] = checksums(data, start, head - 1, CRC8, 8)
    crc = checksums(data, start, length - 2, CRC16, 16)
    data[start + length - 2], data[start + length - 1] = crc >> 8, crc & 0xFF
    raw, signed, result, f = data.tobytes(), (flat ^ 0x80).tobytes(), [], 0
    for i, (size, count, base) in enumerate(zip(sizes.tolist(), frames.tolist(), (np.cumsum(sizes) - sizes).tolist())):
        first, end = int(start[f]), int(start[f + count - 1] + length[f + count - 1])
        points = np.empty(count, POINT)
        points["sample"], points["offset"], points["count"] = number[f : f + count] * block, start[f : f + count] - first, n[f : f + count]
        info = struct.pack(">HH6xQ", block, block, RATE << 44 | 7 << 36 | size) + hashlib.md5(signed[base : base + size]).digest()
        result.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * count).to_bytes(3, "big") + points.tobytes() + raw[first:end])
        f += count
    return result


def metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Samples, their MD5, seek points and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, points, size, digest, last = 4, np.empty(0, POINT), 0, b"", False
    while not last:
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            packed = int.from_bytes(stream[at + 14 : at + 22], "big")
            size, digest = packed & (1 << 36) - 1, stream[at + 22 : at + 38]
            if packed >> 36 & 0xFF != 7:
                raise ValueError("only 8-bit mono streams are read")
        elif kind == 3:
            points = np.frombuffer(stream, POINT, n // 18, at + 4)
        at += 4 + n
    return size, digest, points, at


def decode(streams: Sequence[bytes], first: int = 0, count: int | None = None) -> list[tuple[bytes, list[int]]]:
    """The unsigned 8-bit samples of each stream, and the sample offset of each block among them.

    Every frame's header and whole checksum is verified, and for whole streams their MD5. With ``first`` or ``count``
    only frames that hold these samples are read, found by the seek points. A stream needs a point for every frame.
    """
    parts, starts, stops, owner, offsets, whole, base = [], [], [], [], [], [], 0
    for i, stream in enumerate(streams):
        size, digest, points, at = metadata(stream)
        place = np.append(points["offset"].astype(np.int64) + at, len(stream))
        sample = points["sample"].astype(np.int64)
        if int(points["count"].sum()) != size:
            raise ValueError("the seek table does not hold every frame")
        till = size if count is None else min(size, first + count)
        on = np.flatnonzero((sample < till) & (sample + points["count"] > first))
        parts.append(stream)
        starts.append(place[on] + base)
        stops.append(place[on + 1] + base)
        owner += [i] * len(on)
        offsets.append(sample[on].tolist())
        whole.append((len(on) == len(points), digest))
        base += len(stream)
    data = np.frombuffer(b"".join(parts) + bytes(16), np.uint8)
    start, stop = np.concatenate(starts), np.concatenate(stops)
    samples = _frames(data, start, stop)
    texts: list[list[bytes]] = [[] for _ in streams]
    for i, s in zip(owner, samples):
        texts[i].append(s)
    out = []
    for t, (full, digest), at in zip(texts, whole, offsets):
        joined = b"".join(t)
        if full and any(digest) and hashlib.md5(joined).digest() != digest:
            raise ValueError("the samples' MD5 differs")
        out.append(((np.frombuffer(joined, np.uint8) ^ 0x80).tobytes(), at))
    return out


def _frames(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """Signed samples of each frame at ``data[start:stop]``."""
    if not len(start):
        return []
    crc = data[stop - 2].astype(np.int64) << 8 | data[stop - 1]
    if ((data[start] != 0xFF) | (data[start + 1] != 0xF8)).any() or (checksums(data, start, stop - start - 2, CRC16, 16) != crc).any():
        raise ValueError("a frame's checksum differs")
    lead = data[start + 4]
    digits = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(int) + (lead >= 0xF0)
    code, at = (data[start + 2] >> 4).astype(np.int64), start + 4 + digits
    n = np.select([code == 1, code < 6, code == 6, code == 7], [192, 144 << np.minimum(code, 5), data[at].astype(int) + 1, (data[at].astype(int) << 8 | data[at + 1]) + 1], 256 << np.maximum(code - 8, 0))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    if (checksums(data, start, at - start, CRC8, 8) != data[at]).any():
        raise ValueError("a frame header's checksum differs")
    kind = (data[at + 1] >> 1).astype(np.int64)
    at = at + 2
    samples: list[bytes] = [b""] * len(n)
    for f in np.flatnonzero(kind < 2).tolist():
        samples[f] = bytes(data[at[f] : at[f] + n[f]]) if kind[f] else bytes(data[at[f] : at[f] + 1]) * int(n[f])
    coded = np.flatnonzero(kind >= 8)
    coded = coded[np.argsort(-n[coded], kind="stable")]
    if len(coded):
        x = _restore(data, at[coded] * 8, n[coded], kind[coded])
        for i, f in enumerate(coded.tolist()):
            samples[f] = x[i, : n[f]].tobytes()
    return samples


def _restore(data: np.ndarray, pos: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Predicted frames with their fields at bit ``pos``; sorted by falling ``n``. Residual partitions may be coded
    with any Rice parameter of 4 or 5 bits, or escaped to plain integers."""
    wide = np.zeros(len(data), np.uint64)
    for j in range(8):
        wide[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(56 - 8 * j)

    def window(at: np.ndarray) -> np.ndarray:
        return wide[at >> 3] << (at & 7).astype(np.uint64)

    def read(at: np.ndarray, width) -> np.ndarray:
        return (window(at) >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def sign(value: np.ndarray, width) -> np.ndarray:
        return value - ((value >> np.maximum(np.asarray(width) - 1, 0) & 1) << np.asarray(width))

    m, linear = len(n), kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind - 8)
    most = int(order.max())
    x = np.zeros((int(n[0]), m), np.int64)
    for j in range(most):
        x[j] = np.where(order > j, sign(read(pos + 8 * j, 8), 8), 0)
    pos = pos + 8 * order
    precision, shift = np.where(linear, read(pos, 4) + 1, 0), np.where(linear, read(pos + 4, 5), 0)
    pos = np.where(linear, pos + 9, pos)
    factor = np.zeros((max(most, 1), m), np.int64)
    for j in range(most):
        fixed = np.array([c[j] if len(c) > j else 0 for c in FIXED])[np.where(linear, 0, order)]
        factor[j] = np.where(order > j, np.where(linear, sign(read(pos, precision), precision), fixed), 0)
        pos = np.where(linear & (order > j), pos + precision, pos)
    width = 4 + read(pos, 2)
    part = n >> read(pos + 2, 4)
    pos = pos + 6
    k, raw = np.zeros(m, np.int64), np.full(m, -1)
    left = part - order  # the first partition lacks the warm-up samples
    fresh = np.ones(m, bool)
    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    low = int(order.min())
    even = low == most and bool((part == n).all())
    for i in range(low, int(n[0])):
        c = int(live[i])
        on = slice(0, c) if even or i >= most and not (order[:c] > i).any() else np.flatnonzero(order[:c] <= i)
        new = fresh[on]
        if new.any():
            who = (np.arange(c)[on])[new]
            k[who] = read(pos[who], width[who])
            pos[who] += width[who]
            escaped = who[k[who] == (1 << width[who]) - 1]
            raw[who] = -1
            raw[escaped] = read(pos[escaped], 5)
            pos[escaped] += 5
            fresh[who] = False
        p, kk = pos[on], k[on]
        w = window(p)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1]
        if (top == 0).any():
            q = q.astype(np.int64)
            for f in np.flatnonzero(top == 0).tolist():  # a long run of zeros
                at = int(p[f])
                while not data[at >> 3] >> 7 - (at & 7) & 1:
                    at += 1
                q[f] = at - int(p[f])
            u = q << kk | read(p + q + 1, kk)
        else:
            u = q.astype(np.int64) << kk | (w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        e = u >> 1 ^ -(u & 1)
        size = q + 1 + kk
        plain = raw[on] >= 0
        if plain.any():
            e = np.where(plain, np.where(raw[on] > 0, sign(read(p, np.maximum(raw[on], 1)), np.maximum(raw[on], 1)), 0), e)
            size = np.where(plain, raw[on], size)
        pos[on] = p + size
        guess = np.zeros(len(p), np.int64)
        for j in range(min(most, i)):
            guess += factor[j][on] * x[i - 1 - j][on]
        x[i][on] = e + (guess >> shift[on])
        if not even:
            left[on] -= 1
            done = left[on] == 0
            if done.any():
                who = (np.arange(c)[on])[done]
                fresh[who], left[who] = True, part[who]
    return np.ascontiguousarray(x.T.astype(np.int8))


def payload(text: str | None, unit: int = 192) -> bytes:
    """UTF-8 bytes, filled up with spaces to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit)


def feature(pcm: bytes) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"energy={int(x @ x)};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())}"


def runs(sizes: Sequence[int], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of items that hold about ``most`` together."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def store_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes and ``media``, the FLAC stream of each whole text's padded bytes.

    Null and empty texts are one unit of spaces. Equal texts have equal streams; repeated rows stay; an empty table
    gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            # a character has four bytes at most
            for a, b in runs([len(t or "") if (t or "").isascii() else 4 * len(t) for t in texts]):
                raw = [payload(t) for t in texts[a:b]]
                sizes = [len((t or "").encode()) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(encode(raw), pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_bytes long, media binary")


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``store_media`` with ``pcm`` (unsigned samples), ``block_offsets`` and ``feature`` read from the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in runs([len(s) for s in streams]):
                got = decode(streams[a:b])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.list_(pa.int64())), pa.array([feature(x) for x, _ in got])], names=[key, "n_bytes", "media", "pcm", "block_offsets", "feature"])

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {dict(media.dtypes)[key]}, n_bytes long, media binary, pcm binary, block_offsets array<long>, feature string")


def pcm_blocks(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each block of ``read_media``'s rows: ``key``, block, sample_offset, n_samples and its PCM bytes."""
    rows = read.select(key, "pcm", F.concat("block_offsets", F.array(F.length("pcm").cast("long"))).alias("cuts"))
    rows = rows.select(key, "pcm", "cuts", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("block", "sample_offset"))
    n = F.element_at("cuts", F.col("block") + 2) - F.col("sample_offset")
    return rows.select(key, "block", "sample_offset", n.alias("n_samples"), F.substring("pcm", F.col("sample_offset").cast("int") + 1, n.cast("int")).alias("pcm"))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every text."""
    return read_media(store_media(docs)).select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
