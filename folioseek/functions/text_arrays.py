"""The tokenisers of :mod:`text` over whole Arrow batches: the same tokens, found with numpy.

A regular expression costs about a microsecond a match, as each match is an object of its own.  Here a code point's class is
looked up in a table and tokens are cut from many texts at once.  The table is asked of the expressions of :mod:`text`
themselves, so both ways agree on every code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text

# Texts worked on together have about this many characters.
PIECE = 1 << 18
_OTHER, _INNER, _WORD, _HAN = range(4)
_INNER_CHARS = ".-:"
_QUOTED = re.compile(text._QUOTED)
_CODE_POINTS = 0x110000
_TABLES: dict[str, bytes] = {}


def classes(spark: SparkSession, tokenizer: str) -> bytes:
    """One byte for each code point: whether it is a word character, a Han character, one allowed inside words, or none of these."""
    if tokenizer not in _TABLES:
        points = [chr(i) for i in range(_CODE_POINTS) if not 0xD800 <= i < 0xE000]
        rows = pa.table({"s": ["".join(points[i : i + 4096]) for i in range(0, len(points), 4096)]})
        word = text._WORD_CHAR_NO_HAN if tokenizer == text.HAN else text._WORD_CHAR
        asked = {_WORD: word, _HAN: r"\p{IsHan}"} if tokenizer == text.HAN else {_WORD: word}
        table = np.zeros(_CODE_POINTS, np.uint8)
        table[[ord(c) for c in _INNER_CHARS]] = _INNER
        found = [F.array_join(F.regexp_extract_all("s", F.lit(p), F.lit(0)), "").alias(str(k)) for k, p in asked.items()]
        for row in spark.createDataFrame(rows).select(*found).collect():
            for k in asked:
                table[np.frombuffer(row[str(k)].encode("utf-32-le"), np.uint32)] = k
        _TABLES[tokenizer] = table.tobytes()
    return _TABLES[tokenizer]


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``PIECE`` bytes, with the place of the first; null is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    before = np.cumsum(sizes) - sizes
    cuts = np.flatnonzero(np.diff(before // PIECE)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(sizes)]):
        if z > a:
            yield int(a), [s or "" for s in texts.slice(a, z - a).to_pylist()]


def cut(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, where tokens start and end in them, and the number of tokens of each text."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # a line break stands between texts
    begins = np.cumsum(lengths) - lengths
    kind = table[codes]
    starts, lasts = kind == _HAN, kind == _HAN
    words = np.flatnonzero(kind == _WORD)
    if len(words):
        # Word characters are of one token if nothing but word and inner characters stands between them.
        outside = np.cumsum((kind == _OTHER) | (kind == _HAN), dtype=np.int32)[words]
        new = outside[1:] != outside[:-1]
        starts[words[np.concatenate(([True], new))]] = True
        lasts[words[np.concatenate((new, [True]))]] = True
    for at, s in zip(begins, texts):
        if "'" in s or '"' in s or "`" in s:
            _quoted(s, int(at), starts, lasts)
    first, end = np.flatnonzero(starts), np.flatnonzero(lasts) + 1
    return codes, first, end, np.diff(np.searchsorted(first, np.append(begins, len(codes))))


def _quoted(s: str, at: int, starts: np.ndarray, lasts: np.ndarray) -> None:
    """What stands between a pair of equal quotes is one token, without inner characters at its ends, or none."""
    for m in _QUOTED.finditer(s):
        starts[at + m.start() : at + m.end()] = False
        lasts[at + m.start() : at + m.end()] = False
        inner = s[m.start() + 1 : m.end() - 1]
        core = inner.strip(_INNER_CHARS)
        if core:
            a = at + m.start() + 1 + len(inner) - len(inner.lstrip(_INNER_CHARS))
            starts[a], lasts[a + len(core) - 1] = True, True


def strings(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The tokens as strings."""
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[first] += 1
    edge[end] -= 1
    kept = codes[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    width = 1 + (kept > 0x7F).astype(np.int32) + (kept > 0x7FF) + (kept > 0xFFFF)
    bytes_before = np.concatenate(([0], np.cumsum(width, dtype=np.int32)))
    offsets = bytes_before[np.concatenate(([0], np.cumsum(end - first)))].astype(np.int32)
    data = kept.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def token_count(spark: SparkSession, text_: Column, tokenizer: str) -> Column:
    """:func:`text.token_count`."""
    known = classes(spark, tokenizer)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        table = np.frombuffer(known, np.uint8)
        found = [cut(some, table)[3] for _, some in pieces(texts)]
        return pa.array(np.concatenate(found) if found else [], pa.int32())

    return count(text_)


def runs(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, pa.StringArray, pa.ListArray, np.ndarray]:
    """The distinct tokens of each text: the text's place, the token, its positions in order and the text's number of tokens."""
    codes, first, end, sizes = cut(texts, table)
    found = strings(codes, first, end).dictionary_encode()
    token = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at_text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Text, token and position in one number, so that one sort does it: a piece is short, or one text.
    low, mid = int(sizes.max(initial=0)).bit_length(), len(found.dictionary).bit_length()
    keys = np.sort((at_text << (low + mid)) | (token << low) | at)
    group = keys >> low
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(keys) else np.zeros(0, np.int64)
    positions = pa.ListArray.from_arrays(
        pa.array(np.append(heads, len(keys)).astype(np.int32)), pa.array((keys & ((1 << low) - 1)).astype(np.int32))
    )
    text_at = group[heads] >> mid
    return text_at, found.dictionary.take(pa.array(group[heads] & ((1 << mid) - 1))), positions, sizes[text_at]
