"""BPE encoding and decoding with a contiguous rank array per word.

A word's part boundaries and the rank of each adjacent pair of parts lie in two
parallel arrays. The array is scanned for its minimum, that boundary is deleted and
the ranks of the two neighbouring pairs are looked up anew, until no pair can merge.
A scan is linear, so words of more than `LONG` symbols (a few in a corpus) keep
their candidate pairs in a heap instead; both give the leftmost lowest rank first.

Two flavours of vocabulary files are read, as the JSON file itself says:
  * words: NFC, lower case, white space dropped, a suffix marks the end of a word;
  * bytes: GPT-2 style split that keeps each word's leading blank, nothing dropped.
Encoders are built once per Python worker; finished words are kept in a bounded cache of
two generations: what is used stays, whatever the order of the texts.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_text, map_arrow

LONG = 200
CACHE = 250_000  # words of a generation
_NO = 1 << 60
_WS = regex.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = regex.compile("[\x1c-\x1f]")
_RARE = re.compile("[^\x00-\u024f]")
# fixed values: the split patterns of the two public vocabularies
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Encoder:
    """Ids of texts, equal to those of the tokenizers library without special-token templates."""

    def __init__(self, path: str, cache: int = CACHE, library: bool = False):
        self.cache, self.library = cache, library  # library: words are merged by the tokenizers library, for callers without a method of their own
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {} if library else {m: i for i, m in reversed(list(enumerate(merges)))}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.find = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbol = byte_symbols()
        self.lib = Tokenizer.from_file(path)
        # a word's ids are those of a chunk that is this word, so both have one cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The parts that remain once no adjacent pair has a rank."""
        return self._scan(symbols) if len(symbols) <= LONG else self._heap(symbols)

    def _scan(self, symbols: list[str]) -> list[str]:
        rank, parts = self.rank.get, list(symbols)
        ranks = [rank(p, _NO) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NO:
                break
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NO)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NO)
        return parts

    def _heap(self, symbols: list[str]) -> list[str]:
        parts: list[str | None] = list(symbols)
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self.young) >= self.cache:
            self.old, self.young = self.young, {}
        self.young[key] = ids
        return ids

    def word(self, word: str) -> bytes:
        """The packed ids of one word, from the cache or by merging."""
        out = self.young.get(word)
        if out is None:
            out = self.old.get(word)
            if out is None:
                out = self._ids(list(word) if word.isascii() and word.isalnum() else [self.symbol[b] for b in word.encode("utf-8", "replace")])
            self._keep(word, out)
        return out

    def _ids(self, symbols: list[str]) -> bytes:
        if self.library:
            ids = [t.id for t in self.lib.model.tokenize("".join(symbols))]
        else:
            symbols[-1] += self.suffix
            ids = [self.vocab[p] for p in self.merge(symbols)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # each character alone: a capital sigma at a word's end becomes the ordinary small one
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _chunk(self, chunk: str) -> bytes:
        """The packed ids of what stands between white space, if not in the young cache."""
        out = self.old.get(chunk)
        return self._keep(chunk, self._pieces(chunk) if out is None else out)

    def _pieces(self, chunk: str) -> bytes:
        if not chunk.isascii() and _RARE.search(chunk):  # scripts whose tables differ between Unicode versions: split as the library does
            pieces = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(chunk) if self.lib.normalizer else chunk)
            return b"".join([self._ids(list(p)) for p, _ in pieces])
        text, word = self.normal(chunk), self.word
        if text.isalpha():
            return word(text)
        if text[:-1].isalpha() and text[-1] in ".,;:!?":
            return word(text[:-1]) + word(text[-1])
        return b"".join([word(w) for w in self.find(text)])

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        if self.cut is not None and "<|" in text:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not self.words:
            return b"".join([self.word(w) for w in self.pieces(text)])
        chunks = text.split() if _ODD.search(text) is None else [c for c in _WS.split(text) if c]
        get, miss = self.young.get, self._chunk
        return b"".join([x if (x := get(c)) is not None else miss(c) for c in chunks])

    def pieces(self, text: str) -> list[str]:
        """The consecutive pieces of a text of the bytes flavour; together they are the text."""
        if not _RARE.search(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """As decode(ids, skip_special_tokens=False) of a file without a decoder: the tokens, a blank between."""
        return " ".join([self.token[i] for i in ids])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, cache: int = CACHE, library: bool = False) -> Encoder:
    """One encoder a process and kind; the last kind asked for stays."""
    key = (path, cache, library)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, cache, library)
    return _encoders[key]


def _ids(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row of `df`.

    Whole texts, however long. A null or empty text has no ids; a null or repeated
    doc_id is carried along; other columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [packed(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], _ids(rows)], ["doc_id", "ids"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>")


def _texts(token: np.ndarray, rows: list[bytes]) -> pa.Array:
    """The decoded texts of packed ids."""
    return pa.array([" ".join(token[np.frombuffer(r, "<u4")].tolist()) for r in rows], pa.string())


@functools.cache
def _tokens(path: str) -> np.ndarray:
    """The token of each id; an id that the file doesn't have is an empty text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    return np.array([own.get(i, "") for i in range(max(own) + 1)], object)


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids): the text of the ids, special tokens included; no ids, an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = _texts(token, [np.array(r or (), "<u4").tobytes() for r in part["ids"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], out], ["doc_id", "ids", "decoded"])

    return map_arrow(df.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(df)) in one pass, so ids don't leave the worker in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, token = encoder(path).packed, _tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [packed(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], _ids(rows), _texts(token, rows)], ["doc_id", "ids", "decoded"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decode()'s rows."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
