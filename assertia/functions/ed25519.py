"""Ed25519 (RFC 8032): signing, and verification under a strict acceptance rule.

A signature holds iff its scalar is below the group order, the key and the commitment are canonical encodings of points that are
not of small order, and the equation holds without a cofactor.
"""

from __future__ import annotations

import hashlib

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT_MINUS_ONE = pow(2, (P - 1) // 4, P)
PREFIX = "ed25519:"

Point = tuple[int, int, int, int]
ZERO: Point = (0, 1, 1, 0)


def _add(a: Point, b: Point) -> Point:
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = v - u, d - c, d + c, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out = ZERO
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _pack(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    """The point, if the 32 bytes are its canonical encoding."""
    n = int.from_bytes(data, "little")
    sign, y = n >> 255, n & (1 << 255) - 1
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT_MINUS_ONE % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    if x & 1 != sign:
        x = P - x
    return x, y, 1, x * y % P


_Y = 4 * pow(5, P - 2, P) % P
BASE = _unpack(_Y.to_bytes(32, "little"))


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expand(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_expand(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _expand(seed)
    key = _pack(_times(a, BASE))
    r = _number(prefix, message) % ORDER
    commitment = _pack(_times(r, BASE))
    s = (r + _number(commitment, key, message) % ORDER * a) % ORDER
    return commitment + s.to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    s = int.from_bytes(signature[32:], "little")
    a, r = _unpack(key), _unpack(signature[:32])
    if s >= ORDER or a is None or r is None:
        return False
    if _same(_times(8, a), ZERO) or _same(_times(8, r), ZERO):
        return False
    k = _number(signature[:32], key, message) % ORDER
    return _same(_times(s, BASE), _add(r, _times(k, a)))


def sign_id(seed: bytes, author: str, claim_id: str) -> str:
    """The signature in hex of a claim's id; the author must be the key's name."""
    if author != PREFIX + public_key(seed).hex():
        raise ValueError("the author is not the signing key")
    return sign(seed, bytes.fromhex(claim_id)).hex()


def verify_id(author: str, claim_id: str, signature: str) -> bool:
    try:
        if not author.startswith(PREFIX) or author != author.lower() or signature != signature.lower():
            return False
        return verify(bytes.fromhex(author[len(PREFIX) :]), bytes.fromhex(claim_id), bytes.fromhex(signature))
    except ValueError:
        return False
