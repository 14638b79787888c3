"""The standard security handler, revisions 2 to 4: RC4 and AES-128 in CBC mode."""

from __future__ import annotations

import hashlib

# The padding that the format prescribes for short passwords (fixed value).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class PasswordError(ValueError):
    pass


class MalformedEncryption(ValueError):
    pass


class UnsupportedEncryption(RuntimeError):
    pass


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        out[n] = c ^ s[(a + b) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """A product in the field of AES."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box, made from inverses and the affine map, and its inverse."""
    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        v = inv
        for k in range(1, 5):
            v ^= ((inv << k) | (inv >> (8 - k))) & 255
        box[x] = v ^ 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_made: dict = {}


def _tables():
    if not _made:
        _made["box"], _made["back"] = _boxes()
        _made["mul"] = {k: bytes(_times(x, k) for x in range(256)) for k in (9, 11, 13, 14)}
    return _made["box"], _made["back"], _made["mul"]


def _round_keys(key: bytes) -> list[bytes]:
    box, _, _ = _tables()
    words = [key[i : i + 4] for i in range(0, 16, 4)]
    rcon = 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes([box[w[1]] ^ rcon, box[w[2]], box[w[3]], box[w[0]]])
            rcon = _times(rcon, 2)
        words.append(bytes(a ^ b for a, b in zip(words[i - 4], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


def aes_block(keys: list[bytes], block: bytes) -> bytes:
    """Decrypts 16 bytes."""
    _, back, mul = _tables()
    m9, m11, m13, m14 = (mul[k] for k in (9, 11, 13, 14))
    s = bytes(a ^ b for a, b in zip(block, keys[10]))
    for r in range(9, -1, -1):
        # rows move right, bytes go back through the box, then the round key
        s = bytes(back[s[(i - 4 * (i % 4)) % 16]] ^ keys[r][i] for i in range(16))
        if r:
            out = bytearray(16)
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                out[c] = m14[a] ^ m11[b] ^ m13[d] ^ m9[e]
                out[c + 1] = m9[a] ^ m14[b] ^ m11[d] ^ m13[e]
                out[c + 2] = m13[a] ^ m9[b] ^ m14[d] ^ m11[e]
                out[c + 3] = m11[a] ^ m13[b] ^ m9[d] ^ m14[e]
            s = bytes(out)
    return s


def aes_cbc(key: bytes, data: bytes) -> bytes | None:
    """The data after its initial vector, or None if it is malformed."""
    if len(data) < 32 or len(data) % 16:
        return None
    keys, out, last = _round_keys(key), [], data[:16]
    for i in range(16, len(data), 16):
        block = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(aes_block(keys, block), last)))
        last = block
    plain = b"".join(out)
    pad = plain[-1]
    return plain[:-pad] if 1 <= pad <= 16 and plain.endswith(bytes([pad]) * pad) else None


class Security:
    """Decryption of one document, after its dictionary and a password."""

    def __init__(self, d: dict, file_id: bytes, password: bytes):
        if d.get("Filter") != "Standard":
            raise UnsupportedEncryption(f"security handler {d.get('Filter')}")
        self.v, self.r = d.get("V", 0), d.get("R", 0)
        if self.r not in (2, 3, 4) or self.v not in (1, 2, 4):
            raise UnsupportedEncryption(f"encryption V {self.v} R {self.r}")
        o, u, p = d.get("O"), d.get("U"), d.get("P")
        if not isinstance(o, bytes) or not isinstance(u, bytes) or len(o) < 32 or len(u) < 16 or not isinstance(p, int) or not -(2**31) <= p < 2**32:
            raise MalformedEncryption("incomplete encryption dictionary")
        if not file_id:
            raise MalformedEncryption("encryption without a file id")
        self.o, self.u, self.id = o[:32], u, file_id
        self.p = (p & 0xFFFFFFFF).to_bytes(4, "little")
        bits = 40 if self.v == 1 else d.get("Length", 40 if self.v == 2 else 128)
        self.size = bits // 8 if isinstance(bits, int) and bits >= 40 else 5
        if self.size > 16:
            raise MalformedEncryption("overlong key")
        self.metadata = d.get("EncryptMetadata") is not False
        self.string_way, self.stream_way = self._filter(d, "StrF"), self._filter(d, "StmF")
        if "AESV2" in (self.string_way, self.stream_way):
            self.size = 16
        self.key = self._authenticate(password)

    def _filter(self, d: dict, which: str) -> str:
        if self.v != 4:
            return "V2"
        name = d.get(which, "Identity")
        if name == "Identity":
            return "None"
        filters = d.get("CF")
        way = filters.get(name) if isinstance(filters, dict) else None
        if not isinstance(way, dict):
            raise MalformedEncryption(f"no crypt filter {name}")
        way = way.get("CFM", "None")
        if way not in ("None", "V2", "AESV2"):
            raise UnsupportedEncryption(f"crypt filter {way}")
        return str(way)

    def _key(self, password: bytes) -> bytes:
        h = hashlib.md5((password + PAD)[:32] + self.o + self.p + self.id + (b"\xff\xff\xff\xff" if self.r >= 4 and not self.metadata else b"")).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h[: self.size]).digest()
        return h[: self.size]

    def _opens(self, key: bytes) -> bool:
        if self.r == 2:
            return rc4(key, PAD) == self.u[:32]
        x = hashlib.md5(PAD + self.id).digest()
        for i in range(20):
            x = rc4(bytes(k ^ i for k in key), x)
        return x == self.u[:16]

    def _authenticate(self, password: bytes) -> bytes:
        key = self._key(password)
        if self._opens(key):
            return key
        # as the owner's password, under which the user's is kept
        h = hashlib.md5((password + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            h = hashlib.md5(h).digest()
        h, user = h[: self.size], self.o
        for i in reversed(range(20 if self.r >= 3 else 1)):
            user = rc4(bytes(k ^ i for k in h), user)
        key = self._key(user)
        if self._opens(key):
            return key
        raise PasswordError("wrong password")

    def decrypt(self, data: bytes, number: int, generation: int, way: str) -> bytes:
        if way == "None":
            return data
        salt = b"sAlT" if way == "AESV2" else b""
        h = hashlib.md5(self.key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + salt).digest()
        key = h[: min(len(self.key) + 5, 16)]
        if way == "V2":
            return rc4(key, data)
        plain = aes_cbc(key, data)
        return data if plain is None else plain
