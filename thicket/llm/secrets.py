"""Secrets in texts: fixed patterns, and candidates confirmed by their structure.

A pattern alone cannot tell a key from any other long run of letters. So base64
and hex candidates are decoded and parsed before they are reported:

- ``pem``: a private-key block whose body is a DER or OpenSSH private key, or whose header
  lines name a cipher and whose body is whole blocks of it,
- ``der``: a bare base64 or hex run that is one: nested lengths must add up at
  every level, and the members be those of PKCS#1, DSA, PKCS#8 or SEC1,
- ``ssh``: a bare OpenSSH private key, whose inner string lengths must add up,
  (bare base64 may be wrapped over lines and use the URL-safe letters),
- ``jwt``: a signed token whose header is JSON with an algorithm, whose payload
  is JSON, and whose signature has the length of that algorithm.

One narrow pass over the texts where they lie: no shuffle, state of one text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns, and the least length that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so shorter ones may be left to the engine
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_HEADERS = re.compile(r"\s*((?:[A-Za-z-]+: [^\r\n]*\r?\n)+)\s*\n")
_CIPHER = re.compile(r"^DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]+\r?$", re.M)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC)[A-Za-z0-9+/_-]{22,}={0,2}")
_NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]73)[0-9A-Fa-f]{46,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
# Bytes of a signature; none stands for at least 128.
_SIGNATURE = {
    "HS256": [32], "HS384": [48], "HS512": [64], "ES256": [64], "ES384": [96], "ES512": [132], "ES256K": [64],
    "EdDSA": [64, 114], "Ed25519": [64], "Ed448": [114], "ML-DSA-44": [2420], "ML-DSA-65": [3309], "ML-DSA-87": [4627],
    "RS256": [], "RS384": [], "RS512": [], "PS256": [], "PS384": [], "PS512": [],
}
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
_SSH_MAGIC = b"openssh-key-v1\0"

Span = tuple[str, int, int]


def find_secrets(text: str) -> list[Span]:
    """Kind, start and end (code points, end exclusive), by start, then kind."""
    found = base_spans(text) + confirmed_spans(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough."""
    return (
        [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        + [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        + [("hex", *m.span()) for m in HEX.finditer(text)]
    )


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded bytes have the structure of a key or token."""
    spans: list[Span] = []
    blocks = [m for m in _PEM.finditer(text) if _is_block(m[2])]
    spans += [("pem", *m.span()) for m in blocks]
    bare = [(m.start(), m.end(), _key_kind(_hex(m[0]))) for m in _HEX_BYTES.finditer(text)]
    bare += [_bare_key(text, m) for m in _BASE64.finditer(text)]
    for start, end, kind in bare:
        if kind and not any(b.start() <= start < b.end() for b in blocks):
            spans.append((kind, start, end))
    spans += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if _is_token(*m.groups())]
    return spans


def _is_block(body: str) -> bool:
    headers = _HEADERS.match(body)
    data = _base64(re.sub(r"\s|\\[nr]", "", body[headers.end() :] if headers else body))
    if headers and "ENCRYPTED" in headers[1] and _CIPHER.search(headers[1]):
        return len(data) >= 16 and len(data) % 8 == 0  # whole blocks of a cipher
    return _key_kind(data) is not None


def _bare_key(text: str, match: re.Match) -> tuple[int, int, str | None]:
    """Start, end and kind of the key that a run of base64 begins; it may go on in the next lines.

    The lengths inside say how many letters a key has: it ends with a line, or with its
    own padding.
    """
    kind = _key_kind(_base64(match[0]))
    if kind:
        return match.start(), match.end(), kind
    size = _told_size(_base64(match[0][:24]))
    run, end = match[0], match.end()
    while run[-1] != "=" and (size is None or len(run) * 3 // 4 < size):
        line = _NEXT_LINE.match(text, end)
        if line is None:
            break
        run, end = run + line[1], line.end()
        if size is None and _key_kind(_base64(run)):
            break
    return match.start(), end, _key_kind(_base64(run)) if end > match.end() else None


def _told_size(data: bytes) -> int | None:
    """The size of a DER sequence as its first bytes tell it."""
    if len(data) < 6 or data[0] != _SEQUENCE:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    if width > 4:
        return None
    return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: one row per input row.

    ``base_sha256`` digests the base spans as ``kind:start:end`` joined by commas
    (of no spans: the digest of nothing); ``spans`` lists all spans likewise.
    Null and empty texts have none. Repeated rows are scanned each for itself;
    other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = KINDS[:3]
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for value in batch.column("text"):
            spans = find_secrets(value.as_py() or "")
            own = [s for s in spans if s[0] in base]
            row = [sum(s[0] == kind for s in own) for kind in base]
            row += [hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)]
            for column, cell in zip(columns, row):
                column.append(cell)
        arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _base64(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _hex(run: str) -> bytes:
    return bytes.fromhex(run) if len(run) % 2 == 0 else b""


def _key_kind(data: bytes) -> str | None:
    if data.startswith(_SSH_MAGIC):
        return "ssh" if _is_openssh_key(data) else None
    return "der" if _is_private_key(data) else None


def _is_private_key(data: bytes) -> bool:
    """One DER sequence, nothing behind it, with the members of a private key."""
    top = _members(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return False
    members = _members(data, *top[0][1:])
    if not members:
        return False
    tags = [tag for tag, _, _ in members]
    if len(tags) >= 9 and all(tag == _INTEGER for tag in tags[:9]):
        return True  # PKCS#1
    if tags == [_INTEGER] * 6:
        return data[members[0][1] : members[0][2]] == b"\0" and members[1][2] - members[1][1] >= 64  # DSA
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:
        return _names_algorithm(data, members[1])  # PKCS#8
    if tags[:2] == [_INTEGER, _OCTETS] and set(tags[2:]) <= {0xA0, 0xA1}:
        return data[members[0][1] : members[0][2]] == b"\1" and members[1][2] - members[1][1] >= 16  # SEC1
    return tags == [_SEQUENCE, _OCTETS] and _names_algorithm(data, members[0])  # encrypted PKCS#8


def _names_algorithm(data: bytes, member: tuple[int, int, int]) -> bool:
    inner = _members(data, *member[1:])
    return bool(inner) and inner[0][0] == _OID


def _members(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the contents of each member; None if lengths do not add up."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, length = data[start], data[start + 1]
        start += 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or end - start < width or data[start] == 0:
                return None
            length = int.from_bytes(data[start : start + width], "big")
            start += width
        if length > end - start:
            return None
        out.append((tag, start, start + length))
        start += length
    return out


def _is_openssh_key(data: bytes) -> bool:
    """Cipher, function, its options, a count, and that many public keys and one private part."""
    at, fields = len(_SSH_MAGIC), []

    def string(at: int) -> tuple[bytes | None, int]:
        size = int.from_bytes(data[at : at + 4], "big")
        end = at + 4 + size
        return (data[at + 4 : end], end) if at + 4 <= len(data) and end <= len(data) else (None, at)

    for _ in range(3):
        field, at = string(at)
        if field is None:
            return False
        fields.append(field)
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not fields[0] or not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        field, at = string(at)
        if not field:
            return False
    return at == len(data)


def _is_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = json.loads(_base64(header)), json.loads(_base64(payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict):
        return False
    algorithm, size = head.get("alg"), len(_base64(signature))
    if not isinstance(algorithm, str) or algorithm not in _SIGNATURE:
        return False
    wanted = _SIGNATURE[algorithm]
    return size in wanted if wanted else size >= 128
