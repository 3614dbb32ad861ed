"""Codecs against plain loops over bytes."""

import struct

import numpy as np
import pytest

from plumeria.functions import codecs as C

R = np.random.default_rng(3)


def f16(b):
    return float(np.frombuffer(bytes(b), "<f2")[0])


def plain_q4_0(b):
    out = []
    for at in range(0, len(b), 18):
        s = f16(b[at : at + 2])
        out += [((x & 15) - 8) * s for x in b[at + 2 : at + 18]] + [((x >> 4) - 8) * s for x in b[at + 2 : at + 18]]
    return out


def plain_q5_0(b):
    out = []
    for at in range(0, len(b), 22):
        s, high, q = f16(b[at : at + 2]), int.from_bytes(b[at + 2 : at + 6], "little"), b[at + 6 : at + 22]
        out += [(((q[i % 16] >> (4 if i > 15 else 0)) & 15) + ((high >> i) & 1) * 16 - 16) * s for i in range(32)]
    return out


def six(s, j):
    if j < 4:
        return s[j] & 63, s[j + 4] & 63
    return (s[j + 4] & 15) + ((s[j - 4] >> 6) << 4), (s[j + 4] >> 4) + ((s[j] >> 6) << 4)


def plain_k45(b, size, high):
    out = []
    for at in range(0, len(b), size):
        d, low, s = f16(b[at : at + 2]), f16(b[at + 2 : at + 4]), b[at + 4 : at + 16]
        q = b[at + (48 if high else 16) : at + size]
        for i in range(256):
            group = i // 32
            byte = q[(group // 2) * 32 + i % 32]
            code = byte & 15 if group % 2 == 0 else byte >> 4
            if high:
                code += 16 * ((b[at + 16 + i % 32] >> group) & 1)
            sc, m = six(s, group)
            out.append(d * sc * code - low * m)
    return out


def plain_q6_k(b):
    out = []
    for at in range(0, len(b), 210):
        ql, qh, sc, d = b[at : at + 128], b[at + 128 : at + 192], struct.unpack("16b", b[at + 192 : at + 208]), f16(b[at + 208 : at + 210])
        for i in range(256):
            half, part, l = i // 128, (i % 128) // 32, i % 32  # noqa: E741
            byte = ql[half * 64 + (part % 2) * 32 + l]
            code = ((byte & 15) if part < 2 else (byte >> 4)) + 16 * ((qh[half * 32 + l] >> (2 * part)) & 3) - 32
            out.append(d * sc[i // 16] * code)
    return out


def plain_q2_k(b):
    out = []
    for at in range(0, len(b), 84):
        sc, q, d, low = b[at : at + 16], b[at + 16 : at + 80], f16(b[at + 80 : at + 82]), f16(b[at + 82 : at + 84])
        for i in range(256):
            half, part, l = i // 128, (i % 128) // 32, i % 32  # noqa: E741
            s = sc[i // 16]
            out.append(d * (s & 15) * ((q[half * 32 + l] >> (2 * part)) & 3) - low * (s >> 4))
    return out


def random_blocks(codec, n=5):
    width, size = C.BLOCKS[codec]
    raw = R.integers(0, 256, (n, size)).astype(np.uint8)
    for at in {"q2_k": (80, 82), "q4_k": (0, 2), "q5_k": (0, 2), "q6_k": (208,), "q5_0": (0,), "q4_0": (0,)}[codec]:
        raw[:, at : at + 2] = R.normal(0, 0.1, n).astype("<f2").view(np.uint8).reshape(n, 2)
    return raw.tobytes()


@pytest.mark.parametrize("codec,plain", [
    ("q4_0", plain_q4_0), ("q5_0", plain_q5_0), ("q2_k", plain_q2_k), ("q4_k", lambda b: plain_k45(b, 144, False)), ("q5_k", lambda b: plain_k45(b, 176, True)), ("q6_k", plain_q6_k),
])
def test_decoders_of_blocks(codec, plain):
    b = random_blocks(codec)
    assert np.allclose(C.DECODERS[codec](b).ravel(), plain(b), rtol=1e-5, atol=1e-6)
    with pytest.raises(ValueError):
        C.DECODERS[codec](b[:-1])


@pytest.mark.parametrize("codec,width,bound", [("q8_0", 32, 1 / 127), ("q4_0", 32, 1 / 8), ("q3_k", 256, 1 / 4), ("f16", 1, 1e-3), ("bf16", 1, 8e-3), ("f32", 1, 0), ("fp8_e5m2", 1, 0.13), ("fp8_e4m3", 1, 0.13)])
def test_round_trips(codec, width, bound):
    for n in (0, 1, 31, 32, 64, 300):
        x = R.normal(0, 1, n).astype(np.float32)
        x = np.where(np.abs(x) < 0.02, np.float32(0.5), x)
        got = C.DECODERS[codec](C.ENCODERS[codec](x)).ravel()[:n]
        top = np.array([np.abs(x[k // width * width : (k // width + 1) * width]).max() for k in range(n)]) if width > 1 else np.abs(x)
        assert len(got) == n and (np.abs(got - x) <= bound * top * 1.01 + 1e-6).all()


def test_nf4_permutes_a_block():
    x = C.NF4_LEVELS[R.integers(0, 16, 64)]
    x[[0, 32]] = 1.0
    assert np.allclose(C.decode_nf4(C.encode_nf4(x)).ravel(), x[C.nf4_order(64)], atol=1e-3)
    assert C.encode_nf4(np.zeros(3, np.float32))[2:] == b"\x77" * 16


def test_given_values_of_fp8():
    assert C.encode_fp8_e5m2(np.array([0, 1, -1, 2, 0.5, 65536, -1e30, 57344, np.inf, -np.inf], np.float32)).hex() == "003cbc40387bfb7b7cfc"
    e4 = C.fp8_values(4)
    assert [e4[c] for c in (0x38, 0x7E, 0x7D, 0x08, 0x01)] == [1, 448, 416, 2**-6, 2**-9] and np.isnan(e4[0x7F])
    assert C.encode_fp8_e4m3(np.array([1, 500, 0, -0.0, 1.9999], np.float32)).hex() == "387e00803f"
    # every value of E5M2 is its own encoding
    finite = [c for c in range(256) if np.isfinite(C.fp8_values(5)[c])]
    assert list(C.encode_fp8_e5m2(C.fp8_values(5)[finite])) == finite


def test_bit_shuffle_is_the_transposed_bit_matrix():
    for n in (0, 3, 4, 7, 64, 129):
        b = R.integers(0, 256, n).astype(np.uint8).tobytes()
        whole = n // 4
        want = bytearray(whole * 4)
        for bit in range(32):
            for i in range(whole):
                if b[i * 4 + bit // 8] >> (bit % 8) & 1:
                    want[(bit * whole + i) // 8] |= 1 << ((bit * whole + i) % 8)
        assert C.shuffled(b) == bytes(want) + b[whole * 4 :] and C.unshuffled(C.shuffled(b)) == b


def test_columns(spark):
    rows = [(1, [float(x) for x in R.normal(0, 1, 40)]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id int, x array<float>").withColumn("b", C.encode("q8_0")("x"))
    got = {r.id: r for r in df.select("id", "x", "b", C.decode("q8_0", 40)("b").alias("y"), C.decompress(True)(C.compress(3, True)("b")).alias("c")).collect()}
    assert got[2].b is None and got[2].y is None and got[3].y == [] and np.allclose(got[1].x, got[1].y, atol=0.05)
    assert got[1].c == got[1].b and got[2].c is None
    one = df.selectExpr("id", "b", "cast(x as array<double>) x").select("id", C.block_dot("q8_0")("b", "x").alias("d")).collect()
    assert {r.id: r.d for r in one}[1] == pytest.approx(float(np.dot(got[1].y, got[1].x)), rel=1e-5)
    mixed = spark.createDataFrame([(b"\x00\x3c", "f16", 1), (b"\x80\x3f", "bf16", 1), (None, "f16", 1)], "b binary, codec string, n int")
    assert [r[0] for r in mixed.select(C.decode_by("b", "codec", "n")).collect()] == [[1.0], [1.0], None]
    with pytest.raises(ValueError):
        C.encode("q9")


def test_numbers_next_to_a_half():
    below, above = (np.nextafter(np.float32(0.5), np.float32(x)) for x in (0, 1))
    x = np.array([below, -below, 0.5, -0.5, above, 1.5, -2.5, 0, 8388609, -8388609, np.nextafter(np.float32(2.5), np.float32(0))], np.float32)
    assert C.half_away(x).tolist() == [0, 0, 1, -1, 1, 2, -3, 0, 8388609, -8388609, 2]
    assert np.isnan(C.half_away(np.array([np.nan], np.float32)))[0] and np.isinf(C.half_away(np.array([np.inf], np.float32)))[0]
