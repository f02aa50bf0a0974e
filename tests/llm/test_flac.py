import hashlib
import random
import zlib

import numpy as np
import pytest

from . import cases


def samples():
    rng = random.Random(2)
    text = cases.prose(1, 3000).encode()
    out = [b" " * 192, text[: 192 * 6], text[: 192 * 7], text[: 192 * 61], bytes(rng.randrange(256) for _ in range(192 * 9)), bytes([0, 255] * 96 * 3), b"\x80" * 1152 + text[:384]]
    out.append(bytes(int(128 + 100 * np.sin(i / 9)) for i in range(192 * 12)))
    out.append(bytes([128] * 191 + [255] + [128] * 191 + [0]))
    return out


@pytest.mark.parametrize("block", [1152, 192, 576, 4608])
def test_streams_round_trip(block):
    from verdigris.llm.flac import decode, encode

    streams = encode(samples(), block)
    for p, s, (got, offsets) in zip(samples(), streams, decode(streams)):
        assert got == p and offsets == list(range(0, len(p), block))
        assert decode(encode([p], block))[0][0] == p and encode([p], block)[0] == s


def test_frame_numbers_over_one_byte():
    from verdigris.llm.flac import decode, encode

    long = cases.prose(3, 60_000).encode()
    long = long[: len(long) // 192 * 192]
    stream = encode([long], 192)[0]
    assert decode([stream])[0][0] == long
    part, offsets = decode([stream], 100_000, 500)[0]
    assert offsets[0] <= 100_000 < offsets[0] + 192 and long[offsets[0] : offsets[0] + len(part)] == part and offsets[0] + len(part) >= 100_500


def test_damage_is_found():
    from verdigris.llm.flac import decode, encode

    stream = encode([cases.prose(1, 900).encode()[: 192 * 12]])[0]
    for at in range(150, len(stream), 97):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            decode([bytes(bad)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> j & 1 for j in range(width - 1, -1, -1)]

    def bytes(self):
        return np.packbits(self.bits).tobytes()


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize("method", [0, 1])
def test_foreign_frames(order, method):
    """Fixed predictors of every order, several partitions and an escaped one, written bit by bit."""
    from verdigris.llm import flac

    rng = random.Random(order)
    x = [max(-128, min(127, int(60 * np.sin(i / 11) + rng.gauss(0, 6)))) for i in range(192)]
    e = [x[i] - sum(c * x[i - 1 - j] for j, c in enumerate(flac.FIXED[order])) for i in range(order, 192)]
    b = Bits()
    for v, w in ((0xFFF8, 16), (0x1002, 16), (0, 8)):
        b.put(v, w)
    crc = 0
    for byte in b.bytes():
        crc = int(flac.CRC8[crc ^ byte])
    b.put(crc, 8)
    b.put((8 + order) << 1, 8)
    for v in x[:order]:
        b.put(v & 0xFF, 8)
    b.put(method, 2)
    b.put(2, 4)
    for part in range(4):
        k = [2, None, 0, 7][part]
        b.put((15, 31)[method] if k is None else k, 4 + method)
        if k is None:
            b.put(13, 5)
        for v in e[max(0, 48 * part - order) : 48 * part + 48 - order]:
            if k is None:
                b.put(v & 0x1FFF, 13)
            else:
                u = 2 * v if v >= 0 else -2 * v - 1
                b.put(1, (u >> k) + 1)
                b.put(u & (1 << k) - 1, k)
    frame = b.bytes()
    crc = 0
    for byte in frame:
        crc = (crc << 8 & 0xFFFF) ^ int(flac.CRC16[crc >> 8 ^ byte])
    data = np.frombuffer(frame + crc.to_bytes(2, "big") + bytes(16), np.uint8)
    got = flac._frames(data, np.array([0]), np.array([len(frame) + 2]))
    assert np.frombuffer(got[0], np.int8).tolist() == x


def test_media_table(spark):
    from verdigris.llm.flac import media_digests, pcm_blocks, read_media, store_media

    want = sorted((str(r[0]), len((r[1] or "").encode()), (r[1] or "")) for r in cases.rows())
    got = sorted(media_digests(cases.clashing(cases.table(spark))).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    assert len(got) == len(want)
    for r, (name, n, text) in zip(got, want):
        raw = text.encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (name, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    assert media_digests(cases.table(spark, [])).collect() == []
    blocks = pcm_blocks(read_media(store_media(cases.table(spark, [cases.rows()[63]])))).orderBy("block").collect()
    text = cases.rows()[63][1].encode()
    assert len(blocks) > 10 and b"".join(bytes(r.pcm) for r in blocks).rstrip() == text and all(len(r.pcm) == r.n_samples for r in blocks)
