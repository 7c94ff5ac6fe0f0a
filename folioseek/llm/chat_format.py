"""Chat formatting: whole conversations rendered with control strings, encoded once, with a loss mask by offsets.

A turn is ``[INST]role[/INST]text</s>``.  These strings are control tokens of the encoder, so texts on both sides of
one are encoded apart.  Where a text holds a control string, however many backslashes stand after its first character,
one more is put there; reading takes it out again, so every text survives.  The assistant's text spans, sorted,
meet the tokens' character spans, sorted too, by binary search: that is the loss mask.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, END = "[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"


class Escapes:
    """Reversible escaping of control strings.

    A control string's first character may stand nowhere later in one, and none may hold a backslash: then
    places to escape never overlap, whatever surrounds them.
    """

    def __init__(self, controls: tuple[str, ...]):
        heads = {c[:1] for c in controls}
        if not all(len(c) > 1 for c in controls) or any(h in c[1:] for h in heads for c in controls) or any("\\" in c for c in controls):
            raise ValueError(f"control strings must have two characters or more, no backslash and no later first character: {controls}")
        either = "|".join(f"{re.escape(h)}(?=\\\\*(?:{'|'.join(re.escape(c[1:]) for c in sorted(controls) if c[0] == h)}))" for h in sorted(heads))
        self._in, self._out = re.compile(f"({either})"), re.compile(f"({either})\\\\")

    def escape(self, text: str) -> str:
        return self._in.sub(r"\1\\", text)

    def unescape(self, text: str) -> str:
        return self._out.sub(r"\1", text)


class Rendered(NamedTuple):
    text: str
    loss_spans: list[tuple[int, int]]


def render(turns: list[tuple[str, str]], escapes: Escapes) -> Rendered:
    """The marked-up text of (role, text) turns and the spans in it that are learned from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escapes.escape(role) + BODY, escapes.escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, END
        at += len(head) + len(body) + len(END)
    return Rendered("".join(parts), spans)


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that share a character with one of the spans; spans and tokens both in order."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        low, high = np.array(spans).T
        first = np.searchsorted(ends, low, side="right")
        last = np.searchsorted(starts, high, side="left")
        edges = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(edges, first, 1)
        np.add.at(edges, np.maximum(first, last), -1)
        mask = np.cumsum(edges[:-1]) > 0
    return mask


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under the mask, each without a gap, in order."""
    out, low, high = [], None, 0
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist()):
        if low is not None and s <= high:
            high = max(high, e)
            continue
        if low is not None:
            out.append(text[low:high])
        low, high = s, e
    return out if low is None else [*out, text[low:high]]


def parse(text: str, escapes: Escapes) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns = []
    for turn in text.split(END)[:-1]:
        role, body = turn.removeprefix(OPEN).split(BODY)
        turns.append((escapes.unescape(role), escapes.unescape(body)))
    return turns


#: The split pattern that belongs to the vocabulary, and Unicode's White_Space characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Encoder:
    """A byte-level vocabulary of ranks with the control tokens after it; gives ids and code point offsets.

    ``vocabulary`` is the text of a rank file.  The split pattern can not look over very long white space; such a
    stretch is a piece of its own by that pattern, so it is cut out and merged as one.
    """

    def __init__(self, vocabulary: bytes, specials: tuple[str, ...] = ("<|endoftext|>",), split: str = SPLIT, long_space: int = 5_000):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.controls = (*specials, OPEN, BODY, END)
        ids = {c: max(ranks.values()) + 1 + i for i, c in enumerate(self.controls)}
        self._known = set(self.controls)
        self._text = tiktoken.Encoding("text", pat_str=split, mergeable_ranks=ranks, special_tokens=ids)
        self._piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._widths = np.zeros(max(ids.values()) + 1, dtype=np.int64)
        for token, i in [*ranks.items(), *((c.encode(), i) for c, i in ids.items())]:
            self._widths[i] = len(token)
        after = "|".join(map(re.escape, self.controls))
        self._long = re.compile(f"{_SPACE}{{{long_space},}}(?:(?={after}|\\Z)|(?={_SPACE}))")

    def ids(self, text: str) -> list[int]:
        out, at = [], 0
        for m in self._long.finditer(text):
            out += self._text.encode(text[at : m.start()], allowed_special=self._known, disallowed_special=())
            out += self._piece.encode_ordinary(m.group())
            at = m.end()
        return out + self._text.encode(text[at:], allowed_special=self._known, disallowed_special=())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids and the code points each token touches, from and to."""
        ids = np.array(self.ids(text), dtype=np.int32)
        ends = np.cumsum(self._widths[ids])
        starts = ends - self._widths[ids]
        if not text.isascii():
            lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
            place = np.cumsum(lead) - 1
            starts, ends = place[starts], place[ends - 1] + 1
        return ids, starts.astype(np.int32), ends.astype(np.int32)


PIECE = pa.schema([
    ("piece_task", pa.int32()), ("piece", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())),
    ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
])
_PIECE_DDL = "piece_task int, piece long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_conversations(
    turns: DataFrame, vocabulary: bytes, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_chars: int = 1 << 18
) -> DataFrame:
    """Rendered, encoded and masked conversations: conv_id, piece_task, piece, formatted, token_ids, token_starts, token_ends, loss_mask.

    Rows are ordered by turn (null first), then role and text, so ties and repeated rows have one order; null roles and texts are
    empty; rows of a null id are one conversation; an empty table gives none.  Offsets count code points of ``formatted``.

    A conversation is one row.  It is several, ordered by (piece_task, piece), if it has more than ``piece_chars``
    characters or reaches over the edge of a task: rows are dealt out by ranges of (id, turn), so a conversation with
    a third of all rows is many tasks.  Cuts are between turns, where control tokens stand, so the tokens are those of the whole.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    key_type = rows.schema["conv_id"].dataType.simpleString()
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(tasks, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        escapes, task = Escapes(encoder.controls), TaskContext.get().partitionId()
        key_kind = None

        def close(keys: list, groups: list[list[tuple[str, str]]], first: int) -> pa.RecordBatch:
            done = [render(g, escapes) for g in groups]
            columns: list[list] = [[], [], [], []]
            for r in done:
                ids, starts, ends = encoder.encode(r.text)
                for c, v in zip(columns, (ids, starts, ends, loss_mask(r.loss_spans, starts, ends))):
                    c.append(v)
            values = [[task] * len(done), list(range(first, first + len(done))), [r.text for r in done], *columns]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_kind), *(pa.array(v, f.type) for v, f in zip(values, PIECE))], names=["conv_id", *PIECE.names])

        keys: list = []
        groups: list[list[tuple[str, str]]] = []
        count, size, held, given = 0, 0, 0, 0
        for b in batches:
            key_kind = b.column("conv_id").type
            for key, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                length = len(role) + len(text)
                if not count or key != keys[-1] or size + length > piece_chars:
                    if held > piece_chars:
                        yield close(keys, groups, given)
                        given, keys, groups, held = given + len(keys), [], [], 0
                    keys.append(key)
                    groups.append([])
                    size = 0
                groups[-1].append((role, text))
                count, size, held = count + 1, size + length, held + length
        if keys:
            yield close(keys, groups, given)

    return ordered.select("conv_id", "role", "text").mapInArrow(pieces, f"conv_id {key_type}, {_PIECE_DDL}")


class _Figures:
    """What is read back of one conversation, piece by piece."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: bytes, loss: bytes, n_turns: int, loss_chars: int, formatted_chars: int) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        self.n_turns, self.loss_chars, self.formatted_chars = self.n_turns + n_turns, self.loss_chars + loss_chars, self.formatted_chars + formatted_chars

    def row(self, key: object) -> dict:
        return {
            "conv_id": key, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars,
        }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


_FIGURES = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_FIGURES_DDL = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PASSED_ON = [("task", pa.int32()), ("seq", pa.int64()), ("turns", pa.binary()), ("loss", pa.binary())]


def read_back(formatted: DataFrame, vocabulary: bytes, *, held_bytes: int = 1 << 23) -> DataFrame:
    """Per conversation, from its formatted rows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``turns_sha256`` is over role, line feed, text, line feed of every turn; the loss figures are over the text under the mask, unescaped.
    Rows must come as ``format_conversations`` orders them.  A task finishes all conversations but its first and last, which
    may go on in another task, and those of more than ``held_bytes``: of these it passes on the bytes, piece by piece, and one task
    digests them in order without holding them (a digest has no parts that could be made apart).
    """
    key_type = formatted.schema["conv_id"].dataType.simpleString()
    controls = Encoder(vocabulary).controls

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escapes, task = Escapes(controls), TaskContext.get().partitionId()
        schema = None
        now, now_key, seq = None, None, 0
        passing, waiting, held = True, [], 0
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.column("conv_id").type), *_PASSED_ON, *_FIGURES])
            out = []
            texts, *spans = (b.column(c) for c in ("formatted", "token_starts", "token_ends", "loss_mask"))
            for i, key in enumerate(b.column("conv_id").to_pylist()):
                text = texts[i].as_py()
                found = parse(text, escapes)
                starts, ends, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in spans)
                loss = "".join(escapes.unescape(t) for t in masked_texts(text, starts, ends, mask))
                turns = "".join(f"{r}\n{t}\n" for r, t in found).encode()
                if now is None or key != now_key:
                    if now and not passing:
                        out.append(now.row(now_key))
                    passing, waiting, held = now is None, [], 0
                    now, now_key = _Figures(), key
                piece = {"turns": turns, "loss": loss.encode(), "n_turns": len(found), "loss_chars": len(loss), "formatted_chars": len(text)}
                now.add(**piece)
                waiting.append({"conv_id": key, "task": task, "seq": seq, **piece})
                seq, held = seq + 1, held + len(turns)
                if passing or held > held_bytes:
                    out += waiting
                    passing, waiting = True, []
            if out:
                yield _batch(out, schema)
        if waiting:
            yield _batch(waiting, schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, now_key = None, None, None
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.column("conv_id").type), *_FIGURES])
            out = []
            for r in b.to_pylist():
                if now and (r["turns"] is None or r["conv_id"] != now_key):
                    out.append(now.row(now_key))
                    now = None
                if r["turns"] is None:
                    out.append(r)
                    continue
                now, now_key = now or _Figures(), r["conv_id"]
                now.add(r["turns"], r["loss"], r["n_turns"], r["loss_chars"], r["formatted_chars"])
            if out:
                yield _batch(out, schema)
        if now:
            yield _batch([now.row(now_key)], schema)

    found = formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(
        read, f"conv_id {key_type}, task int, seq long, turns binary, loss binary, {_FIGURES_DDL}"
    )
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(fold, f"conv_id {key_type}, {_FIGURES_DDL}")
