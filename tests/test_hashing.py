import numpy as np

from sigspark.functions.hashing import bucket_and_sign, hash_rows, murmur3_32


def _mm_ref(data: bytes, seed: int = 0) -> int:
    c1, c2 = 0xCC9E2D51, 0x1B873593
    h, n = seed, len(data)
    for i in range(0, n // 4 * 4, 4):
        k = int.from_bytes(data[i:i + 4], "little")
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
        h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    t, k = data[n // 4 * 4:], 0
    for j in range(len(t) - 1, -1, -1):
        k ^= t[j] << (8 * j)
    if t:
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
    h ^= n
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def test_known_vectors():
    assert list(murmur3_32([b"foo", b"hello"])) == [-156908512, 613153351]


def test_against_reference_random():
    rng = np.random.default_rng(0)
    toks = [bytes(rng.integers(0, 256, size=int(n), dtype=np.uint8)) for n in rng.integers(0, 40, size=300)]
    assert list(murmur3_32(toks)) == [_mm_ref(t) for t in toks]


def test_bucket_and_sign_rule():
    idx, sign = bucket_and_sign(np.array([-5, 5, -2147483648], dtype=np.int32), 4)
    assert list(idx) == [1, 1, (2147483647 - 3) % 4]
    assert list(sign) == [-1.0, 1.0, -1.0]


def test_hash_rows_signed_and_weights():
    m = hash_rows([[("foo", 1.0), ("foo", 2.0)], []], 8, True)
    h = _mm_ref(b"foo")
    assert m.shape == (2, 8)
    assert m[0, abs(h) % 8] == (3.0 if h >= 0 else -3.0)
    assert m[1].sum() == 0
