"""Format-preserving encryption: an alternating Feistel network over strings of an alphabet."""

from __future__ import annotations

import hashlib
import hmac

ROUNDS = 10


def _round(key: bytes, i: int, radix: int, half: list[int], size: int) -> list[int]:
    mark = hmac.new(key, bytes([i]) + b"%d %d " % (radix, size) + b",".join(b"%d" % x for x in half), hashlib.sha256).digest()
    n, out = int.from_bytes(mark + hmac.new(key, mark, hashlib.sha256).digest(), "big"), []
    for k in range(size):
        if k and k % 24 == 0:  # more digits than the number gives evenly
            n = int.from_bytes(hmac.new(key, mark + b"%d" % k, hashlib.sha512).digest(), "big")
        out.append(n % radix)
        n //= radix
    return out


def permute(key: bytes, alphabet: str, text: str, *, back: bool = False) -> str:
    """A bijection of the strings of text's length over alphabet; back inverts it."""
    radix, at = len(alphabet), {c: i for i, c in enumerate(alphabet)}
    v = [at[c] for c in text]
    if len(v) == 1:  # no halves: a shift of its own for each alphabet
        shift = _round(key, 0, radix, [], 1)[0]
        return alphabet[(v[0] + (-shift if back else shift)) % radix]
    cut = len(v) // 2
    a, b = v[:cut], v[cut:]
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2 == 0:
            a = [(x - y if back else x + y) % radix for x, y in zip(a, _round(key, i, radix, b, len(a)))]
        else:
            b = [(x - y if back else x + y) % radix for x, y in zip(b, _round(key, i, radix, a, len(b)))]
    return "".join(alphabet[x] for x in a + b)
