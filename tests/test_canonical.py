import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from assertia.functions import canon as C
from assertia.functions import ed25519 as E
from assertia.functions.blake3 import content_address, digests

VALUES = st.recursive(
    st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.binary(max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=4), inner, max_size=4),
    max_leaves=12,
)


@given(VALUES)
def test_round_trip(value):
    data = C.encode(value)
    assert C.encode(C.decode(data)) == data
    assert C.decode(data) == value


def test_shortest_floats():
    assert C.encode(1.5).hex() == "f93e00" and C.encode(-0.0).hex() == "f90000"
    assert C.encode(100000.0).hex() == "fa47c35000" and C.encode(0.1)[0] == 0xFB
    assert C.encode(2.0**-24).hex() == "f90001"
    assert C.encode({"bb": 1.0, "a": True, "b": False}).hex() == "a36161f56162f4626262f93c00"


@pytest.mark.parametrize("data", [b"\x01", b"\xf6", b"\x9f\xff", b"\xa1\xf5\xf5", b"\xf5\xf5", b"\xc0\x60", b"\x62a", b"\xa2\x61a\xf5\x61a\xf5", b"\xf9\x7c\x00", b"\x62\xff\xff", b"\x78\x01a", b"\x98\x00", b"\xfa\x3f\xc0\x00\x00", b"\xf9\x80\x00", b"\xa2\x61b\xf5\x61a\xf5"])
def test_strict_decoding(data):
    with pytest.raises(ValueError):
        C.decode(data)


def test_refusals():
    for bad in (1, None, float("nan"), {1: True}):
        with pytest.raises((TypeError, ValueError)):
            C.encode(bad)
    for bad in ("a", "ab==", "a+b_", "AB", "QUJD\n"):
        with pytest.raises(ValueError):
            C.b64u_decode(bad)
    assert C.b64u_decode("iVBORw0KGgo") == b"\x89PNG\r\n\x1a\n"


# fixed values: published digests of the input 0, 1, ..., 250, 0, ... of each length
BLAKE3 = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"}


def test_blake3():
    data = bytes(i % 251 for i in range(40_000))
    for n, want in BLAKE3.items():
        assert digests([data[:n]])[0].hex() == want
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 16384, 31744, 40_000]
    together = digests([data[:n] for n in sizes])
    assert together == [digests([data[:n]])[0] for n in sizes] and len(set(together)) == len(sizes)
    assert content_address(b"").startswith("1e20af1349")
    assert digests([]) == []


def test_ed25519_rfc_vector():
    # fixed values: the first test of RFC 8032
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = E.public_key(seed)
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = E.sign(seed, b"")
    assert sig.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert E.verify(key, b"", sig) and not E.verify(key, b"x", sig)
    s = int.from_bytes(sig[32:], "little")
    assert not E.verify(key, b"", sig[:32] + (s + E.ORDER).to_bytes(32, "little"))
    assert not E.verify(bytes(32), b"", sig) and not E.verify(b"\x01" + bytes(31), b"", sig)
    claim = content_address(b"claim")
    assert E.verify_id(E.PREFIX + key.hex(), claim, E.sign_id(seed, E.PREFIX + key.hex(), claim))
    with pytest.raises(ValueError):
        E.sign_id(seed, "someone", claim)


def test_struct_agrees():
    assert C.encode(1.1) == b"\xfb" + struct.pack(">d", 1.1)
