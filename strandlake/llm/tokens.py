"""Token counts by offset-mapped attribution.

A whole document is encoded once; the character spans of its tokens are interval-joined
to its sections, and a token that crosses a boundary goes by an explicit rule:
  start: to the section of its first character,
  end: to that of its last character,
  most: to the section with most of its characters, of equals the first.
Pieces of the pre-tokeniser that lie within one section, nearly all, are counted without
looking at their tokens; an added token, such as one for the end of a text, is a piece and
one token wherever a text spells it. A token's span runs from the character of its first byte to that
of its last byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import id_text, map_arrow

RULES = ("start", "end", "most")


def lines(text: str) -> list[int]:
    """The starts of a text's lines; a line holds the break that ends it. At least one, even if empty."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def spans(own: bpe.Encoder, piece: str) -> list[tuple[int, int]]:
    """(first character, one past the last) of each token of a piece."""
    if piece in own.special:
        return [(0, len(piece))]
    sizes = [len(own.token[i]) for i in np.frombuffer(own.word(piece), "<u4").tolist()]  # a symbol a byte
    if piece.isascii():
        char = range(len(piece))
    else:
        char = [i for i, c in enumerate(piece) for _ in range(len(c.encode("utf-8", "replace")))]
    out, at = [], 0
    for size in sizes:
        out.append((char[at], char[at + size - 1] + 1))
        at += size
    return out


def attribute(own: bpe.Encoder, text: str, starts: list[int], rule: str) -> np.ndarray:
    """The number of tokens of each section; the sections begin at `starts` and follow each other."""
    pieces = own.pieces(text) if own.cut is None or "<|" not in text else [p for part in own.cut.split(text) for p in ([part] if part in own.special else own.pieces(part))]
    bounds = np.array(starts)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    word, special = own.word, own.special
    count = np.fromiter((1 if p in special else len(word(p)) // 4 for p in pieces), np.int64, len(pieces))
    begin = np.cumsum(size) - size
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, begin + size - 1, "right") - 1
    whole = first == last
    out = np.bincount(first[whole], count[whole], len(starts)).astype(np.int64)
    for i in np.flatnonzero(~whole).tolist():
        for a, b in spans(own, pieces[i]):
            a, b = a + int(begin[i]), b + int(begin[i])
            if rule == "most":
                parts = [(min(b, starts[s + 1] if s + 1 < len(starts) else b) - max(a, starts[s]), -s) for s in range(int(first[i]), int(last[i]) + 1)]
                at = -max(parts)[1]
            else:
                at = int(np.searchsorted(bounds, a if rule == "start" else b - 1, "right")) - 1
            out[at] += 1
    return out


def count(docs: DataFrame, path: str, sections: Callable[[str], list[int]] = lines, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, length, n_tokens): one row a section of each row of `docs`.

    `sections` gives the ascending starts of a text's sections, 0 first; section counts
    from 0, start and length are in characters. The counts of a document add up to its
    tokens. A null or empty text has one section without tokens. Null and repeated ids are
    carried along; other columns are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"one of {RULES} is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, cols = [], [[], [], [], []]
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    starts = sections(text)
                    n = attribute(own, text, starts, rule)
                    ids += [doc] * len(starts)
                    edge = np.array([*starts, len(text)])
                    for c, x in zip(cols, (np.arange(len(starts)), edge[:-1], np.diff(edge), n)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c), pa.int64()) for c in cols)], ["doc_id", "section", "start", "length", "n_tokens"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, section long, start long, length long, n_tokens long")
