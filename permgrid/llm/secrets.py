"""Secret scan with structural confirmation (operator 10).

Three patterns always report: assignments, access key names and long hexadecimal runs.
Beyond them, candidates in base64 or hexadecimal are decoded and parsed, and reported only
when their structure holds:

* ``der``: nested tag-length-value data whose lengths add up exactly and whose content is a
  key: a PKCS#1, PKCS#8, EC or public-key layout (base64, also in PEM armour, or hex);
* ``ssh``: the length-prefixed layout of an OpenSSH private or public key;
* ``jwt``: three URL-safe base64 parts whose first is a JSON header with ``alg`` and whose
  second is a JSON object.

Spans are code points, the end exclusive.  Edge cases: a null text is empty; a text without
secrets has no spans and the digest of an empty string; repeated rows and ids give a row
each; other columns are ignored; whole texts are scanned, whatever their length; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permgrid.llm.links import text_batches

# The base patterns, by kind and in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "der", "jwt", "ssh"]

BASE64_RUN = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{64,}")
SEQUENCE, INTEGER, BITS, OCTETS, NULL, OID = 0x30, 0x02, 0x03, 0x04, 0x05, 0x06


def read_der(data: bytes, start: int = 0, end: int | None = None):
    """(tag, content start, content end) of the element at ``start``; None if lengths do not hold."""
    end = len(data) if end is None else end
    if end - start < 2:
        return None
    tag, n, at = data[start], data[start + 1], start + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at:at + size], "big")
        at += size
        if n < 128 or (size > 1 and n < 1 << 8 * (size - 1)):
            return None  # not the shortest form
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, start: int, end: int):
    """The elements of a constructed value; None unless they fill it exactly."""
    out = []
    while start < end:
        e = read_der(data, start, end)
        if e is None:
            return None
        out.append(e)
        start = e[2]
    return out


def is_key(data: bytes) -> bool:
    """True for DER that lies in ``data`` from end to end and is laid out as a key."""
    top = read_der(data)
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]

    def algorithm(p):
        inner = children(data, p[1], p[2]) if p[0] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OID and inner[0][2] > inner[0][1]

    version = tags[0] == INTEGER and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 2
    rsa = version and len(tags) in (9, 10) and all(t == INTEGER for t in tags[1:9])
    dsa = version and len(tags) == 6 and all(t == INTEGER for t in tags)
    pkcs8 = version and len(tags) >= 3 and algorithm(parts[1]) and tags[2] == OCTETS
    ec = version and data[parts[0][1]] == 1 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16
    encrypted = len(tags) == 2 and algorithm(parts[0]) and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 32
    public = len(tags) == 2 and algorithm(parts[0]) and tags[1] == BITS
    rsa_public = tags == [INTEGER, INTEGER] and parts[0][2] - parts[0][1] >= 64
    return rsa or dsa or pkcs8 or ec or encrypted or public or rsa_public


def is_ssh(data: bytes) -> bool:
    """True for an OpenSSH private key blob, or a public one whose fields add up."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at:at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and bool(re.match(rb"(ssh-|ecdsa-sha2-)[a-z0-9-]+\Z", fields[0]))


def unbase64(s: str) -> bytes | None:
    try:
        return base64.b64decode(s, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_jwt(s: str) -> bool:
    parts = s.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_secrets(text: str):
    """(base spans, confirmed spans), each a list of (kind, start, end)."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] \
        if ":" in text or "=" in text else []
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = []
    if "eyJ" in text:
        more += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_jwt(m.group())]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = unbase64("".join(m.group(2).split()))
            if data and is_key(data):
                more.append(("der", m.start(), m.end()))
            elif data and is_ssh(data):
                more.append(("ssh", m.start(), m.end()))
    taken = [(s, e) for _, s, e in more]
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    for m in BASE64_RUN.finditer(text):
        run = m.group()
        if free(m.start(), m.end()):
            data = unbase64(run + "=" * (-len(run) % 4) if "=" not in run else run)
            if data and is_key(data):
                more.append(("der", m.start(), m.end()))
            elif data and is_ssh(data):
                more.append(("ssh", m.start(), m.end()))
    for m in HEX_ANY.finditer(text):
        if len(m.group()) % 2 == 0 and free(m.start(), m.end()) and is_key(bytes.fromhex(m.group())):
            more.append(("der", m.start(), m.end()))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(set(more), key=order)


def _scan(batches):
    import hashlib

    import pyarrow as pa
    show = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    for b in batches:
        rows = []
        for text in b.column(1):
            base, more = find_secrets(text.as_py() or "")
            kinds = [k for k, _, _ in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more),
                         hashlib.sha256(show(base).encode()).hexdigest(), show(sorted(base + more, key=order))))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column(0)] + [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts of base matches, their digest, and all spans."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, "
                                  "base_sha256 string, spans string")
