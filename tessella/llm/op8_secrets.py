"""Secret scans with structural confirmation.

Base patterns find assignments, access ids and long hex strings. Beyond them, candidates are decoded and parsed before
they are reported: base64 and hex runs must hold a private key whose DER lengths nest exactly (``der``) or an OpenSSH
key whose length-prefixed fields do (``ssh``), armoured blocks must decode to one of these (``pem``), and signed tokens
must have a JSON header that names an algorithm and a JSON body (``jwt``). A random string of the right alphabet fails.
Armour may have its line ends written as escapes, as in JSON or settings files, and header lines; if these say that the
body is encrypted, it must be whole cipher blocks with an initial vector. Encrypted PKCS#8 is told by its algorithm.

A vectorised pass over the bytes first finds the texts that can hold any of it (runs of the alphabets, marks, key words);
only those are matched, whole. Edge cases: null is empty and has no spans; repeated rows are scanned alike; texts may be
of any length; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import texts

#: In the order in which kinds stand at equal starts.
KINDS = ("assign", "access", "hex", "pem", "jwt", "ssh", "der")
BASE = KINDS[:3]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s\\,:.]|-(?!----))*)-----END \1-----")
HEADER = re.compile(r"[A-Za-z][A-Za-z-]*: ")
CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*")
# Object identifiers (1.2.840.113549.1.5 and .1.12.1) below which password-based encryption stands.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[Mb][A-Za-z0-9+/_-]{30,}={0,2}")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9a-f]{2}){24,}|(?<![0-9A-Fa-f])30(?:[0-9A-F]{2}){24,}")


def _decode64(s: str) -> bytes | None:
    s = re.sub(r"\s+", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, from, to) of the DER element at a place; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or at + more > end or raw[at] == 0:
            return None
        n, at = int.from_bytes(raw[at : at + more]), at + more
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a range exactly."""
    out = []
    while at < end:
        e = _element(raw, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def is_der_key(raw: bytes) -> bool:
    """Whether the bytes are one private key: PKCS#1, SEC 1 or PKCS#8, plain or encrypted, nested lengths exact."""
    top = _element(raw, 0, len(raw))
    if top is None or top[0] != 0x30 or top[2] != len(raw):
        return False
    parts = _children(raw, top[1], top[2])
    if parts and [p[0] for p in parts] == [0x30, 0x04]:  # encrypted PKCS#8
        name = _children(raw, parts[0][1], parts[0][2])
        return bool(name) and name[0][0] == 0x06 and raw[name[0][1] : name[0][2]].startswith(ENCRYPTIONS) and parts[1][2] - parts[1][1] >= 16
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    tags = [p[0] for p in parts]
    if len(parts) >= 6 and all(t == 0x02 for t in tags):  # PKCS#1 and DSA: whole numbers only
        return all(p[2] > p[1] for p in parts)
    if len(parts) >= 2 and tags[1] == 0x04 and raw[parts[0][1]] == 1:  # SEC 1
        return parts[1][2] - parts[1][1] >= 16
    if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8
        name = _children(raw, parts[1][1], parts[1][2])
        return bool(name) and name[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16
    return False


def is_ssh_key(raw: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: the magic, then fields whose lengths fill the rest."""
    magic = b"openssh-key-v1\0"
    if not raw.startswith(magic):
        return False
    at = len(magic)

    def field():
        nonlocal at
        n = int.from_bytes(raw[at : at + 4])
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    if any(field() is None for _ in range(3)) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4])
    at += 4
    return 1 <= keys <= 16 and all(field() is not None for _ in range(keys + 1)) and at == len(raw)


def is_armoured_key(body: str) -> bool:
    """Whether what stands between the marks of an armoured block is a private key."""
    lines = re.sub(r"\\[rn]", "\n", body).split("\n")
    lines = [x.strip() for x in lines if x.strip()]
    named = [x for x in lines if HEADER.match(x)]
    raw = _decode64("".join(x for x in lines if not HEADER.match(x)))
    if not raw:
        return False
    if any(x.startswith("Proc-Type: 4,ENCRYPTED") for x in named):
        iv = next((m[1] for x in named if (m := CIPHER.fullmatch(x))), "")
        return bool(iv) and len(raw) >= 16 and len(raw) % (len(iv) // 2) == 0
    return is_der_key(raw) or is_ssh_key(raw)


def is_token(header: str, body: str) -> bool:
    """Whether two parts of a signed token are JSON objects, the first naming an algorithm."""
    try:
        head, claims = (json.loads(_decode64(x) or b"") for x in (header, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def scan(text: str) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) in code points, by start, then kind."""
    found = []
    low = text.translate(_ASCII_LOWER) if any(w in text for w in "=:") else ""
    if low and any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text) if is_armoured_key(m[2])]
    if "ey" in text:
        found += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
    for m in BASE64.finditer(text):
        raw = _decode64(m[0])
        if raw and is_ssh_key(raw):
            found.append((m.start(), 5, m.end()))
        elif raw and is_der_key(raw):
            found.append((m.start(), 6, m.end()))
    found += [(m.start(), 6, m.end()) for m in HEXKEY.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _runs(mask: np.ndarray, edge: np.ndarray, least: int) -> np.ndarray:
    """Starts of the runs of at least so many true bytes; edge: where a text begins, and so a new run."""
    inside = np.concatenate([[False], mask, [False]])
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start[end - start >= least]


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold a span: whether each has a long enough run, a mark or a key word with = or :."""
    out = np.zeros(len(offsets) - 1, bool)
    hexes, words = np.zeros(256, bool), np.zeros(256, bool)
    hexes[[*b"0123456789abcdef"]] = True
    words[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-."]] = True
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    edges = np.zeros(len(raw) + 1, bool)
    edges[offsets] = True
    for start in range(0, len(raw), texts.PIECE):  # pieces overlap by the longest mark and run
        piece = raw[start : start + texts.PIECE + 64]
        edge = edges[start : start + len(piece) + 1]
        hit = [_runs(hexes[piece], edge, 24), _runs(words[piece], edge, 19)]
        folded, plain = low[piece].tobytes(), piece.tobytes()
        marks = [m.start() for w in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key") for m in re.finditer(re.escape(w), folded)]
        marks += [m.start() for m in re.finditer(rb"AKIA|-----BEGIN", plain)]
        at = np.concatenate([*hit, np.array(marks, np.int64)]).astype(np.int64) + start
        out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: array of (start, kind, end), end exclusive, in code points, by start, then kind."""

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for b in texts.sub_batches(batches):
            hit = suspects(*texts.text_bytes(b.column(1)))
            found = [[{"start": a, "kind": k, "end": e} for a, k, e in scan(b.column(1)[i].as_py())] if h else [] for i, h in enumerate(hit.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "found"])

    key = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(texts.trimmed(find), f"id {key}, found array<struct<start:bigint,kind:string,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with every span (joined where they overlap) replaced by a mark. Null texts stay null."""

    def clean(batches):
        for b in texts.sub_batches(batches, text_col):
            i = b.schema.get_field_index(text_col)
            column = b.column(i)
            hit = np.flatnonzero(suspects(*texts.text_bytes(column)))
            if len(hit):
                values = column.to_pylist()
                for j in hit.tolist():
                    values[j] = hide(values[j], mark)
                b = b.set_column(i, b.schema.field(i), pa.array(values, column.type))
            yield b

    return docs.mapInArrow(texts.trimmed(clean), docs.schema)


def hide(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents with counts and a digest of the base spans, and all spans."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    digest = F.sha2(F.array_join(F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","), 256)
    counts = [F.size(F.filter("found", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, digest.alias("base_sha256"), written.alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind
