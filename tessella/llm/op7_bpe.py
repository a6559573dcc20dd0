"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is split at special tokens and by the vocabulary's pattern; each part is merged by itself. The tree's leaves hold
the rank of the pair that starts at each symbol, its nodes the least (rank, place) below, so the root is the leftmost
pair of the lowest rank. Merging it changes three leaves, each an update of logarithmic cost, and ends when the root
says that no pair can be merged; a part of n bytes takes O(n log n), however long and whatever it holds.

Encoded parts of at most SHORT characters are remembered in each worker process, up to CACHE of them (about 330 MB): those
met since the last CACHE / 2 new ones, and those before them, so parts that go on occurring stay. Memory is bounded and
results do not depend on it. The vocabulary (a file of fixed size) is read
once by the driver and broadcast.

Edge cases: null is empty; an empty text has no tokens; a special token's string in a text is that token, as in the
library's default; repeated rows are encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import texts

CACHE, SHORT = 1_000_000, 48
#: Largest vocabulary file that is broadcast.
MOST_BYTES = 16 << 20
_NONE = 1 << 62

# The split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Ranges of code points that are letters or numbers to ``regex`` but were not yet assigned in the Unicode
# version of the library whose results are to be met; there they are neither.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


class Vocabulary(NamedTuple):
    """What encoding and decoding need, small and plain, to be broadcast."""

    name: str
    byte_ids: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, id)
    tokens: list[bytes]  # by id
    special: dict[str, int]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library."""
    raw = open(path, "rb").read()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {MOST_BYTES} are broadcast")
    spec = json.loads(raw)
    model, letters = spec["model"], byte_letters()
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    ids, back = model["vocab"], {x: b for b, x in enumerate(letters)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
    for t in spec["added_tokens"]:
        if other := [f for f in ("lstrip", "rstrip", "single_word") if t.get(f)]:
            raise ValueError(f"{path}: the token {t['content']!r} has {', '.join(other)}, which is not supported")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Vocabulary(hashlib.sha256(raw).hexdigest(), [ids[x] for x in letters], merges, tokens, special)


class PairTree:
    """Least (rank, place) over the pairs of neighbouring symbols."""

    def __init__(self, symbols: list[int], merges: dict):
        self.symbols, self.merges = symbols, merges
        n = len(symbols)
        self.width = width = 1 << max(n - 2, 0).bit_length()
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.step = n  # keys are rank * step + place
        get = merges.get
        leaves = [_NONE if (m := get(p)) is None else m[0] * n + i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
        self.node = node = [_NONE] * width + leaves + [_NONE] * (width - len(leaves))
        for i in range(width - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def _set(self, place: int, key: int) -> None:
        node, i = self.node, self.width + place
        if node[i] == key:
            return
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                return
            node[i] = low
            i >>= 1

    def _rank(self, place: int) -> int:
        """The key of the pair that starts at a place."""
        nxt = self.after[place]
        if nxt >= self.step:
            return _NONE
        m = self.merges.get((self.symbols[place], self.symbols[nxt]))
        return _NONE if m is None else m[0] * self.step + place

    def merge(self) -> list[int]:
        """The symbols left when no pair can be merged."""
        symbols, after, before, node = self.symbols, self.after, self.before, self.node
        n = self.step
        while (root := node[1]) != _NONE:
            i = root % n
            j = after[i]
            symbols[i] = self.merges[symbols[i], symbols[j]][1]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            if j < self.width:
                self._set(j, _NONE)
            self._set(i, self._rank(i))
            if (h := before[i]) >= 0:
                self._set(h, self._rank(h))
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out


class Coder:
    """Encodes and decodes; one in each worker process for a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split = regex.compile(PATTERN).findall
        later = "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())
        self.later = regex.compile(f"[{later}]").search
        exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", "@").replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]").replace("@", rf"[^\s[\p{{L}}\p{{N}}--[{later}]]]")
        self.split_exactly = regex.compile(exact, regex.V1).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")").split if vocabulary.special else None
        self.written: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def part(self, part: str) -> list[int]:
        """Ids of one part of the split."""
        raw = part.encode()
        ids = [self.v.byte_ids[b] for b in raw]
        return PairTree(ids, self.v.merges).merge() if len(ids) > 1 else ids

    def parts(self, text: str) -> list[str]:
        if not text.isascii() and self.later(text):
            return self.split_exactly(text)
        return self.split(text)

    def pieces(self, text: str):
        """(text, special id or None) of the stretches between and at special tokens."""
        if self.cut is None or not any(s in text for s in self.v.special):
            return [(text, None)]
        return [(x, self.v.special.get(x) if i % 2 else None) for i, x in enumerate(self.cut(text)) if x]

    def encode(self, text: str) -> list[int]:
        out = []
        for x, special in self.pieces(text):
            if special is not None:
                out.append(special)
            else:
                for p in self.parts(x):
                    out += self.part(p)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.v.tokens[i] for i in ids).decode("utf-8", "replace")

    def _fill(self, part: str) -> tuple[str, bytes]:
        made = self.written.get(part) or self.older.get(part)
        if made is None:
            ids = self.part(part)
            made = ",".join(map(str, ids)), b"".join([self.v.tokens[i] for i in ids])
        if len(part) <= SHORT:
            if len(self.written) >= CACHE // 2:
                self.older, self.written = self.written, {}
            self.written[part] = made
        return made

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by commas, decoded text), the decoded text from the ids' bytes."""
        get, fill, written, raw = self.written.get, self._fill, [], []
        for x, special in self.pieces(text):
            if special is not None:
                made = [(str(special), self.v.tokens[special])]
            else:
                made = [get(p) or fill(p) for p in self.parts(x)]
            written += [m[0] for m in made]
            raw += [m[1] for m in made]
        ids = ",".join(written)
        return ids.count(",") + 1 if ids else 0, ids, b"".join(raw).decode("utf-8", "replace")


def _coder(shared) -> Coder:
    """This process's coder for a broadcast vocabulary."""
    v = shared.value
    coders = sys.__dict__.setdefault("_tessella_coders", {})
    if v.name not in coders:
        coders[v.name] = Coder(Vocabulary(*v))
    return coders[v.name]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids``: the token ids of every text."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path)), dict(docs.dtypes)[id_col]

    def run(batches):
        coder = _coder(shared)
        for b in texts.sub_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path)), dict(docs.dtypes)[id_col]

    def run(batches):
        coder, sha = _coder(shared), hashlib.sha256
        for b in texts.sub_batches(batches):
            rows = [coder.round_trip(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sha(i.encode()).hexdigest() for _, i, _ in rows], pa.string()), pa.array([sha(t.encode()).hexdigest() for _, _, t in rows], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def vocabulary_path() -> str:
    """The public 50k byte-level vocabulary where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """All documents encoded with the public 50k byte-level vocabulary and decoded again."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
