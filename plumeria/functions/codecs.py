"""Tensor codecs on bytes: columns of floats to payloads and back, whole blocks at a time in Arrow tasks.

``encode(codec)`` makes a function from array<float> to binary, ``decode(codec)`` one from binary to array<float>. A null stays
null. A payload that is no whole number of blocks is an error that names the codec. ``decode(codec, n)`` cuts the padding of
the last block off.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the NF4 format, as decoders must have them.
NF4_LEVELS = np.array([
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
], np.float32)

#: Fixed values of the block formats: elements and bytes of a block.
BLOCKS = {
    "q8_0": (32, 34), "q4_0": (32, 18), "q5_0": (32, 22), "nf4": (32, 18), "q3_k": (256, 110), "q2_k": (256, 84), "q4_k": (256, 144), "q5_k": (256, 176),
    "q6_k": (256, 210),
}
RAW = {"f64": "<f8", "f32": "<f4", "f16": "<f2", "i64": "<i8", "i32": "<i4", "i16": "<i2", "i8": "i1", "u64": "<u8", "u32": "<u4", "u16": "<u2", "u8": "u1", "bool": "?"}


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero; adding a half first would round up the number just below one half."""
    whole = np.trunc(x)
    with np.errstate(invalid="ignore"):
        return (whole + np.copysign(np.abs(x - whole) >= 0.5, x)).astype(np.float32)


def _blocks_of(x: np.ndarray, width: int, pad: float = 0.0) -> np.ndarray:
    rows = -(-len(x) // width)
    out = np.full(rows * width, pad, np.float32)
    out[: len(x)] = x
    return out.reshape(rows, width)


def _scale(rows: np.ndarray, divisor: float) -> np.ndarray:
    top = np.abs(rows).max(axis=1, initial=0.0).astype(np.float32)
    return np.where(top > 0, top / np.float32(divisor), np.float32(1)).astype(np.float32)[:, None]


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype("<f2").view(np.uint8).reshape(len(x), 2)


def encode_bf16(x: np.ndarray) -> bytes:
    bits = x.astype("<f4").view(np.uint32)
    return np.where(np.isnan(x), (bits >> 16) | 64, (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2").tobytes()


def encode_q8_0(x: np.ndarray) -> bytes:
    """Scale max / 127, kept in half precision; quotients by the single-precision scale."""
    rows = _blocks_of(x, 32)
    s = _scale(rows, 127)
    q = np.clip(half_away(rows / s), -127, 127).astype(np.int8)
    return np.concatenate([_half(s), q.view(np.uint8)], axis=1).tobytes()


def encode_q4_0(x: np.ndarray) -> bytes:
    """Scale max / 8; element i is a byte's low half, element i + 16 its high half; padding is code 8."""
    rows = _blocks_of(x, 32)
    s = _scale(rows, 8)
    q = (np.clip(half_away(rows / s), -8, 7) + 8).astype(np.uint8)
    return np.concatenate([_half(s), q[:, :16] | (q[:, 16:] << 4)], axis=1).tobytes()


def encode_nf4(x: np.ndarray) -> bytes:
    """Scale max; the first of the nearest levels, halves of a byte as in q4_0; padding is the level of zero.

    The format's decoder reads both halves of a byte in a row, so a round trip permutes a block: see nf4_order().
    """
    rows = _blocks_of(x, 32)
    s = _scale(rows, 1)
    q = np.abs((rows / s)[:, :, None] - NF4_LEVELS).argmin(axis=2).astype(np.uint8)
    return np.concatenate([_half(s), q[:, :16] | (q[:, 16:] << 4)], axis=1).tobytes()


def nf4_order(n: int) -> np.ndarray:
    """Where each decoded element of an NF4 payload was before it was encoded."""
    block = np.arange(32).reshape(2, 16).T.ravel()
    return (np.arange(-(-n // 32))[:, None] * 32 + block).ravel()


def encode_q3_k(x: np.ndarray) -> bytes:
    """Blocks of 256 with one scale max / 4: 32 bytes of high bits, 64 of low pairs, 12 zero bytes, the scale."""
    rows = _blocks_of(x, 256)
    s = _scale(rows, 4)
    q = (np.clip(half_away(rows / s), -4, 3) + 4).astype(np.uint8)
    high = np.packbits(q >> 2, axis=1, bitorder="little")
    low = ((q & 3).reshape(len(q), 64, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8)
    return np.concatenate([high, low, np.zeros((len(q), 12), np.uint8), _half(s)], axis=1).tobytes()


def encode_fp8_e5m2(x: np.ndarray) -> bytes:
    """Nearest, ties to even, saturated at 57344; infinities and NaN are kept; subnormals round halves away from zero."""
    x = x.astype(np.float32)
    bits = x.view(np.uint32)
    sign = ((bits >> 31) << 7).astype(np.uint8)
    exponent, fraction = ((bits >> 23) & 255).astype(np.int32) - 112, bits & 0x7FFFFF
    short, rest = fraction >> 21, fraction & 0x1FFFFF
    short = short + ((rest > 0x100000) | ((rest == 0x100000) & (short & 1 == 1)))
    normal = np.minimum(exponent.astype(np.int64) * 4 + short, 0x7B)
    with np.errstate(over="ignore", invalid="ignore"):
        small = np.minimum(np.nan_to_num(half_away(np.abs(x) * np.float32(65536)), posinf=4), 4)
    out = np.where(exponent <= 0, small, normal).astype(np.uint8)
    out = np.where(np.isnan(x), 0x7F, np.where(np.isinf(x), 0x7C, out)).astype(np.uint8)
    return (sign | out).tobytes()


def encode_fp8_e4m3(x: np.ndarray) -> bytes:
    """The truncating form: no rounding, no subnormals (the exponent stops at 0), saturated at 448."""
    x = x.astype(np.float32)
    bits = x.view(np.uint32)
    exponent = np.clip(((bits >> 23) & 255).astype(np.int32) - 120, 0, 15)
    out = (exponent << 3) | ((bits >> 20) & 7).astype(np.int32)
    out = np.where(x == 0, 0, np.where(np.abs(x) >= 448, 0x7E, out))
    return (((bits >> 31) << 7).astype(np.uint8) | out.astype(np.uint8)).tobytes()


def fp8_values(exponent_bits: int) -> np.ndarray:
    """All 256 values of FP8 with 4 (no infinities) or 5 exponent bits."""
    code = np.arange(256)
    m = 7 - exponent_bits
    bias = (1 << (exponent_bits - 1)) - 1
    e, f = (code >> m) & ((1 << exponent_bits) - 1), code & ((1 << m) - 1)
    value = np.where(e == 0, f * 2.0 ** (1 - bias - m), (1 + f / 2.0**m) * 2.0 ** (e - bias))
    if exponent_bits == 5:
        value = np.where(e == 31, np.where(f == 0, np.inf, np.nan), value)
    else:
        value = np.where(code & 127 == 127, np.nan, value)
    return np.where(code >= 128, -value, value).astype(np.float32)


def _rows(payload: bytes, codec: str) -> np.ndarray:
    size = BLOCKS[codec][1]
    if len(payload) % size:
        raise ValueError(f"{codec}: {len(payload)} bytes are no whole blocks of {size}")
    return np.frombuffer(payload, np.uint8).reshape(-1, size)


def _f16(rows: np.ndarray, at: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, at : at + 2]).view("<f2").astype(np.float32)


def _nibbles(q: np.ndarray, groups: int) -> np.ndarray:
    """Low halves of each group of bytes, then its high halves."""
    q = q.reshape(len(q), groups, q.shape[1] // groups)
    return np.stack([q & 15, q >> 4], axis=2).reshape(len(q), 2 * groups * q.shape[2])


def decode_q8_0(b: bytes) -> np.ndarray:
    r = _rows(b, "q8_0")
    return np.ascontiguousarray(r[:, 2:]).view(np.int8).astype(np.float32) * _f16(r, 0)


def decode_q4_0(b: bytes) -> np.ndarray:
    r = _rows(b, "q4_0")
    return (_nibbles(r[:, 2:], 1).astype(np.float32) - 8) * _f16(r, 0)


def decode_q5_0(b: bytes) -> np.ndarray:
    r = _rows(b, "q5_0")
    high = np.unpackbits(np.ascontiguousarray(r[:, 2:6]), axis=1, bitorder="little")
    return (_nibbles(r[:, 6:], 1) + high * np.float32(16) - 16) * _f16(r, 0)


def decode_nf4(b: bytes) -> np.ndarray:
    r = _rows(b, "nf4")
    q = r[:, 2:]
    return NF4_LEVELS[np.stack([q & 15, q >> 4], axis=2).reshape(len(q), 32)] * _f16(r, 0)


def decode_q3_k(b: bytes) -> np.ndarray:
    """The layout of encode_q3_k(): the 12 scale bytes are not read."""
    r = _rows(b, "q3_k")
    high = np.unpackbits(np.ascontiguousarray(r[:, :32]), axis=1, bitorder="little")
    low = ((r[:, 32:96, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(r), 256)
    return (low + high * np.float32(4) - 4) * _f16(r, 108)


def decode_q2_k(b: bytes) -> np.ndarray:
    """16 groups of 16: scale and minimum are halves of a byte, in units of two half-precision factors."""
    r = _rows(b, "q2_k")
    sc = r[:, :16]
    q = (r[:, 16:80].reshape(len(r), 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3
    q = q.reshape(len(r), 16, 16).astype(np.float32)
    d, low = _f16(r, 80), _f16(r, 82)
    return ((d * (sc & 15))[:, :, None] * q - (low * (sc >> 4))[:, :, None]).reshape(len(r), 256)


def _six_bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minima of 6 bits, packed in 12 bytes."""
    a, b, c = s[:, :4], s[:, 4:8], s[:, 8:12]
    return np.concatenate([a & 63, (c & 15) | ((a >> 6) << 4)], axis=1), np.concatenate([b & 63, (c >> 4) | ((b >> 6) << 4)], axis=1)


def _k_affine(r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Eight groups of 32 codes with 6-bit scales and minima."""
    scale, low = _six_bits(r[:, 4:16])
    q = q.reshape(len(r), 8, 32).astype(np.float32)
    return ((_f16(r, 0) * scale)[:, :, None] * q - (_f16(r, 2) * low)[:, :, None]).reshape(len(r), 256)


def decode_q4_k(b: bytes) -> np.ndarray:
    r = _rows(b, "q4_k")
    return _k_affine(r, _nibbles(r[:, 16:], 4))


def decode_q5_k(b: bytes) -> np.ndarray:
    r = _rows(b, "q5_k")
    high = (r[:, None, 16:48] >> np.arange(8, dtype=np.uint8)[:, None]) & 1
    return _k_affine(r, _nibbles(r[:, 48:], 4) + high.reshape(len(r), 256) * 16)


def decode_q6_k(b: bytes) -> np.ndarray:
    """Two halves of 128: low nibbles of 64 bytes, then high ones, each with two more bits; 16 signed scales of 16 elements."""
    r = _rows(b, "q6_k")
    low = _nibbles(r[:, :128], 2).reshape(len(r), 2, 4, 32)
    high = (r[:, 128:192].reshape(len(r), 2, 1, 32) >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3
    q = (low | (high << 4)).astype(np.float32) - 32
    scale = np.ascontiguousarray(r[:, 192:208]).view(np.int8).astype(np.float32)
    return ((_f16(r, 208) * scale)[:, :, None] * q.reshape(len(r), 16, 16)).reshape(len(r), 256)


def _raw(codec: str) -> tuple[Callable, Callable]:
    kind = np.dtype(RAW[codec])

    def decode(b: bytes) -> np.ndarray:
        if len(b) % kind.itemsize:
            raise ValueError(f"{codec}: {len(b)} bytes are no whole elements of {kind.itemsize}")
        return np.frombuffer(b, kind).astype(np.float32)

    return (lambda x: x.astype(kind).tobytes()), decode


def decode_bf16(b: bytes) -> np.ndarray:
    if len(b) % 2:
        raise ValueError(f"bf16: {len(b)} bytes are no whole elements of 2")
    return (np.frombuffer(b, "<u2").astype(np.uint32) << 16).view(np.float32)


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {c: _raw(c)[0] for c in RAW} | {
    "bf16": encode_bf16, "q8_0": encode_q8_0, "q4_0": encode_q4_0, "nf4": encode_nf4, "q3_k": encode_q3_k, "fp8_e5m2": encode_fp8_e5m2, "fp8_e4m3": encode_fp8_e4m3,
}
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {c: _raw(c)[1] for c in RAW} | {
    "bf16": decode_bf16, "q8_0": decode_q8_0, "q4_0": decode_q4_0, "q5_0": decode_q5_0, "nf4": decode_nf4, "q3_k": decode_q3_k, "q2_k": decode_q2_k, "q4_k": decode_q4_k,
    "q5_k": decode_q5_k, "q6_k": decode_q6_k, "fp8_e5m2": lambda b: fp8_values(5)[np.frombuffer(b, np.uint8)], "fp8_e4m3": lambda b: fp8_values(4)[np.frombuffer(b, np.uint8)],
}


def _known(codec: str, table: dict) -> Callable:
    if codec not in table:
        raise ValueError(f"unknown codec {codec}; there are {', '.join(sorted(table))}")
    return table[codec]


def encode(codec: str):
    """A column function: array<float> to the codec's bytes."""
    _known(codec, ENCODERS)

    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        own = ENCODERS[codec]
        return x.map(lambda v: None if v is None else own(np.asarray(v, np.float32)))

    return run


def decode(codec: str, n: int | None = None):
    """A column function: the codec's bytes to array<float>, the first ``n`` elements if given."""
    _known(codec, DECODERS)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        own = DECODERS[codec]
        return x.map(lambda v: None if v is None else own(bytes(v)).ravel()[:n])

    return run


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_by(payload: pd.Series, codec: pd.Series, n: pd.Series) -> pd.Series:
    """Payloads of different codecs: the first n elements of each; a null codec or payload gives null, an unknown codec an error."""
    return pd.Series([
        None if b is None or c is None else _known(c, DECODERS)(bytes(b)).ravel()[: None if k is None or k != k else int(k)]
        for b, c, k in zip(payload, codec, n, strict=True)
    ])


def shuffled(b: bytes, size: int = 4) -> bytes:
    """The bit matrix of elements of ``size`` bytes transposed; bytes past the last element stay behind it."""
    whole = len(b) // size * size
    bits = np.unpackbits(np.frombuffer(b[:whole], np.uint8).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits.T.ravel(), bitorder="little").tobytes() + b[whole:]


def unshuffled(b: bytes, size: int = 4) -> bytes:
    whole = len(b) // size * size
    bits = np.unpackbits(np.frombuffer(b[:whole], np.uint8), bitorder="little").reshape(size * 8, -1)
    return np.packbits(bits.T.ravel(), bitorder="little").tobytes() + b[whole:]


def _bytes_function(own: Callable[[bytes], bytes]):
    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else own(bytes(v)))

    return run


def bit_shuffle(size: int = 4):
    """A column function: bytes with the bits of their elements transposed."""
    return _bytes_function(lambda b: shuffled(b, size))


def bit_unshuffle(size: int = 4):
    return _bytes_function(lambda b: unshuffled(b, size))


def compress(level: int = 3, shuffle: bool = False):
    """A column function: bytes as one zstd frame, with their bits shuffled before if asked for."""

    def own(b: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(shuffled(b) if shuffle else b)

    return _bytes_function(own)


def decompress(shuffle: bool = False):
    def own(b: bytes) -> bytes:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(b)
        return unshuffled(raw) if shuffle else raw

    return _bytes_function(own)


def block_dot(codec: str):
    """A column function (payload, x): the dot product of a payload's row of weights with array<double> x, decoded in the task.

    Weights past the end of x are padding. Fewer weights than elements of x are an error.
    """
    _known(codec, DECODERS)

    @F.pandas_udf(T.DoubleType())
    def run(payload: pd.Series, x: pd.Series) -> pd.Series:
        def one(b, v):
            if b is None or v is None:
                return None
            w = DECODERS[codec](bytes(b)).ravel()
            if len(w) < len(v):
                raise ValueError(f"{len(w)} weights for {len(v)} elements")
            return float(w[: len(v)].astype(np.float64) @ np.asarray(v, np.float64))

        return pd.Series([one(b, v) for b, v in zip(payload, x, strict=True)])

    return run
