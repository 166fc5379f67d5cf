"""Canonical bytes: the float-only CBOR profile, its strict decoder, and unpadded base64url.

Python values stand for items: ``str``, ``bool``, ``float`` (an ``int`` is refused unless it came from JSON, see ``from_json``),
``bytes``, ``list`` and ``dict`` with string keys.
"""

from __future__ import annotations

import base64
import math
import struct


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("too long")


def _float(x: float) -> bytes:
    if not math.isfinite(x):
        raise ValueError("numbers are finite")
    x = x + 0.0  # -0.0 becomes 0.0
    for code, fmt in ((0xF9, ">e"), (0xFA, ">f")):
        try:
            packed = struct.pack(fmt, x)
        except OverflowError:
            continue
        if struct.unpack(fmt, packed)[0] == x:
            return bytes([code]) + packed
    return b"\xfb" + struct.pack(">d", x)


def encode(value: object) -> bytes:
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, float):
        return _float(value)
    if isinstance(value, str):
        data = value.encode()
        return head(3, len(data)) + data
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, list | tuple):
        return head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        items = sorted((encode(k), v) for k, v in value.items() if _text_key(k))
        return head(5, len(items)) + b"".join(k + (v.data if isinstance(v, Encoded) else encode(v)) for k, v in items)
    if isinstance(value, Encoded):
        return value.data
    raise TypeError(f"no canonical form for {type(value).__name__}")


class Encoded:
    """Bytes that are canonical already, as a part of a larger item."""

    __slots__ = ("data",)

    def __init__(self, data: bytes):
        self.data = bytes(data)

    def __lt__(self, other: object) -> bool:  # ties of equal keys cannot occur in a dict
        return False


def _text_key(k: object) -> bool:
    if not isinstance(k, str):
        raise TypeError("map keys are text")
    return True


def from_json(value: object) -> object:
    """JSON numbers as floats; null is refused."""
    if isinstance(value, bool | str | float | bytes):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, list | tuple):
        return [from_json(v) for v in value]
    if isinstance(value, dict):
        return {k: from_json(v) for k, v in value.items()}
    raise TypeError("null has no canonical form")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("unexpected end")
        self.at += n
        return self.data[self.at - n : self.at]

    def length(self, info: int) -> int:
        if info < 24:
            return info
        if info > 27:
            raise ValueError("definite lengths only")
        return int.from_bytes(self.take(1 << (info - 24)), "big")

    def item(self) -> object:
        first = self.take(1)[0]
        major, info = first >> 5, first & 31
        if first in (0xF4, 0xF5):
            return first == 0xF5
        if first in (0xF9, 0xFA, 0xFB):
            fmt = {0xF9: ">e", 0xFA: ">f", 0xFB: ">d"}[first]
            x = struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]
            if not math.isfinite(x):
                raise ValueError("numbers are finite")
            return x
        if major == 2:
            return self.take(self.length(info))
        if major == 3:
            return self.take(self.length(info)).decode()
        if major == 4:
            return [self.item() for _ in range(self.length(info))]
        if major == 5:
            out: dict[str, object] = {}
            for _ in range(self.length(info)):
                key = self.item()
                if not isinstance(key, str) or key in out:
                    raise ValueError("distinct text keys only")
                out[key] = self.item()
            return out
        raise ValueError("item outside the profile")


def decode(data: bytes) -> object:
    reader = _Reader(bytes(data))
    value = reader.item()
    if reader.at != len(data):
        raise ValueError("trailing bytes")
    if encode(value) != data:
        raise ValueError("not the shortest form, or keys out of order")
    return value


def b64u_encode(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def b64u_decode(text: str) -> bytes:
    """Canonical form only: the alphabet, no padding, trailing bits zero."""
    if not text.isascii() or set(text) & set("+/=") or len(text) % 4 == 1:
        raise ValueError("not base64url")
    data = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
    if b64u_encode(data) != text:
        raise ValueError("not canonical base64url")
    return data
