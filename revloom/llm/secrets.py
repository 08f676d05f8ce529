"""Secret scan with structural confirmation.

Three pattern kinds are reported as found (``assign``, ``access``, ``hex``). For other credentials a pattern
is only a candidate, reported when its inside confirms it:

* ``pem``: a key block whose base64 body decodes to nested lengths that add up (DER) or to an OpenSSH key;
* ``jwt``: three dotted parts whose first decodes to a JSON header with an algorithm;
* ``key``: a base64 or hex run that decodes to a DER sequence of a key's size with exact nested lengths, or
  to an SSH key blob.

Spans are half-open ranges of code points. Null and empty texts have no span. Every row is scanned by itself, so
repeated rows repeat, and other columns do no harm. Long texts are scanned whole.
"""

import base64
import binascii
import hashlib
import json
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from revloom.llm.words import text_of

KINDS = ("assign", "access", "hex", "pem", "jwt", "key")
BASE = KINDS[:3]

# fixed values: the patterns of the contract
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----(.*?)-----END \1-----", re.DOTALL)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
LEAST_KEY_BYTES = 32


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional."""
    body = re.sub(r"\s+", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that fill ``raw[start:end]`` exactly, else None."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = raw[start], raw[start + 1], start + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(raw[start:start + n], "big"), start + n
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def is_der_key(raw: bytes) -> bool:
    """One sequence whose lengths add up and that holds an integer, and a further integer, sequence, bit or
    octet string: the shape of private and public key encodings."""
    outer = der_items(raw, 0, len(raw))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or len(raw) < LEAST_KEY_BYTES:
        return False
    inner = der_items(raw, outer[0][1], outer[0][2])
    if not inner or len(inner) < 2 or inner[0][0] not in (0x02, 0x30):
        return False
    for tag, low, high in inner:
        if tag == 0x30 and der_items(raw, low, high) is None:
            return False
    return all(tag in (0x02, 0x03, 0x04, 0x06, 0x05, 0x30, 0x31, 0xA0, 0xA1) for tag, *_ in inner)


def is_ssh_key(raw: bytes) -> bool:
    """An OpenSSH key file, or a public key blob whose length-prefixed fields fill it."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(raw) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def _is_key(raw: bytes | None) -> bool:
    return raw is not None and (is_der_key(raw) or is_ssh_key(raw))


def _pem_body(body: str) -> bytes | None:
    """The base64 body of a block, without header lines of encrypted keys."""
    lines = [x.strip() for x in body.strip().splitlines() if ":" not in x]
    return decode_base64("".join(lines))


def _is_token(header: str) -> bool:
    try:
        found = json.loads(decode_base64(header) or b"")
    except (ValueError, RecursionError):
        # no JSON, or nested too deeply for a header
        return False
    return isinstance(found, dict) and "alg" in found


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind as listed in ``KINDS``."""
    text = text or ""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # no run of that length without a word of that length
    long = [w for w in text.split() if len(w) >= 16]
    if long:
        spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        spans += [(*m.span(), "pem") for m in _PEM.finditer(text) if _is_key(_pem_body(m[2]))]
    if "eyJ" in text:
        spans += [(*m.span(), "jwt") for m in _JWT.finditer(text) if _is_token(m[1])]
    if any(len(w) >= 40 for w in long):
        key = {m.span() for m in _BASE64.finditer(text) if _is_key(decode_base64(m[0]))}
        key |= {m.span() for m in _HEX_ANY.finditer(text) if _is_key(bytes.fromhex(m[0]))}
        spans += [(*span, "key") for span in key]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, spans) -> str | None:
    """The text with every span, or run of overlapping spans, replaced by one mark."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]]) if merged else text


def _scan(batches):
    for batch in batches:
        found = [find_secrets(t) for t in text_of(batch, "text")]
        base = [[s for s in spans if s[2] in BASE] for spans in found]
        counts = [[sum(s[2] == kind for s in spans) for spans in base] for kind in BASE]
        digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
             pa.array([joined(s) for s in found], pa.string()),
             pa.array([len(s) - len(b) for s, b in zip(found, base)], pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])


def secret_spans(documents: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
               "spans string, n_confirmed long")


def _redact(batches, place: int, length: int | None):
    for batch in batches:
        texts = [redact(t, find_secrets(t)) for t in batch.column(place).to_pylist()]
        columns = list(batch.columns)
        columns[place] = pa.array(texts, pa.string())
        if length is not None:
            old = columns[length]
            same = batch.column(place).to_pylist()
            sizes = [o if a == b else len(b) for o, a, b in zip(old.to_pylist(), same, texts)]
            columns[length] = pa.array(sizes, old.type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def redact_secrets(documents: DataFrame) -> DataFrame:
    """All documents with their columns, secrets replaced by marks and ``n_chars`` kept true."""
    names = documents.columns
    length = names.index("n_chars") if "n_chars" in names else None
    return documents.mapInArrow(partial(_redact, place=names.index("text"), length=length),
                                documents.schema)
