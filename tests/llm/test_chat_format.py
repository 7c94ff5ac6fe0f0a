import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioseek.llm.chat_format import Encoder, Escapes, format_conversations, loss_mask, masked_texts, parse, read_back, render
from folioseek.llm.queries import TOKENIZER

with open(TOKENIZER, "rb") as vocabulary:
    RANKS = vocabulary.read()
ENCODER = Encoder(RANKS)
PIECES = ["[INST]", "[/INST]", "</s>", "<|endoftext|>", "[\\INST]", "<\\\\/s>", "\\", "<", "[", "INST]", "hello", " ", "\n", "é", "日本", "👩‍🚀", "<s", "/s>", "[[INST]]", "  x", "\x00"]


def some_text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))


def test_escapes():
    controls = ENCODER.controls
    escapes, rng = Escapes(controls), random.Random(1)
    seen = {}
    for _ in range(20_000):
        t = some_text(rng)
        e = escapes.escape(t)
        assert escapes.unescape(e) == t and not any(c in e for c in controls) and seen.setdefault(e, t) == t
    with pytest.raises(ValueError):
        Escapes(("<a<b>", "<c>"))


def test_encoding_in_pieces_is_the_encoding_of_the_whole():
    escapes, rng = Escapes(ENCODER.controls), random.Random(2)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "", "[INST]"]), some_text(rng)) for _ in range(rng.randint(1, 7))]
        r = render(turns, escapes)
        ids, starts, ends = ENCODER.encode(r.text)
        at = rng.randint(0, len(turns))
        parts = [ENCODER.ids(render(t, escapes).text) for t in (turns[:at], turns[at:])]
        assert parts[0] + parts[1] == ids.tolist() and parse(r.text, escapes) == turns
        mask = loss_mask(r.loss_spans, starts, ends)
        assert mask.tolist() == [any(s < b and a < e for a, b in r.loss_spans) for s, e in zip(starts, ends)]
        found = [escapes.unescape(t) for t in masked_texts(r.text, starts, ends, mask)]
        assert found == [t for role, t in turns if role == "assistant" and t]


def test_encoder_against_another_library():
    tok = Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    tok.add_special_tokens([c for c in ENCODER.controls if tok.token_to_id(c) is None])
    rng = random.Random(4)
    spaces = [" ", "\n", "\u3000", "\x1c", "\t "]
    short = Encoder(RANKS, long_space=3)
    for _ in range(400):
        t = some_text(rng) + "".join(rng.choice(spaces) * rng.randint(0, 9) + rng.choice(["a", "</s>", "", "'s", "1"]) for _ in range(4))
        code = tok.encode(t, add_special_tokens=False)
        for e in (ENCODER, short):
            ids, starts, ends = e.encode(t)
            assert [e._text.decode([i]) for i in ids if i >= 50256] == [tok.id_to_token(i) for i in code.ids if i >= 50256]
            assert [i for i in ids if i < 50256] == [i for i in code.ids if i < 50256] and list(zip(starts, ends)) == code.offsets
    for t in (" " * 2_000_000, "\n" * 1_000_000 + "x", "x" * 300_000 + " " * 20_000 + "</s>"):
        ids, starts, ends = ENCODER.encode(t)
        assert starts[0] == 0 and ends[-1] == len(t) and (starts[1:] == ends[:-1]).all()


def expected(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    escapes, out = Escapes(ENCODER.controls), set()
    for key in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(t for role, t in turns if role == "assistant")
        size = sum(17 + len(escapes.escape(r)) + len(escapes.escape(t)) for r, t in turns)
        out.add((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size))
    return out


@pytest.mark.parametrize("piece_chars,held", [(1 << 18, 1 << 23), (40, 100)])
def test_conversations(spark, piece_chars, held):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), some_text(rng)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(7, 100 + t, "assistant", some_text(rng)) for t in range(200)]  # a hot conversation
    rows += [(None, 0, "user", "x"), (None, None, None, None), (3, 0, "assistant", None), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup")]
    rows += [(500, 0, "assistant", "long </s> " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("task", F.lit(1)).withColumn("formatted", F.lit("clash"))
    formatted = format_conversations(df, RANKS, piece_chars=piece_chars)
    got = {tuple(r) for r in read_back(formatted, RANKS, held_bytes=held).collect()}
    assert got == expected(rows)
    assert format_conversations(df.limit(0), RANKS).collect() == [] and read_back(format_conversations(df.limit(0), RANKS), RANKS).collect() == []
    parts = formatted.filter("conv_id = 7").collect()
    assert len(parts) > 1 and len({p.piece_task for p in parts}) > 1  # split over tasks by turn
    parts.sort(key=lambda p: (p.piece_task, p.piece))
    assert ENCODER.ids("".join(p.formatted for p in parts)) == [i for p in parts for i in p.token_ids]
    for p in parts:
        assert len(p.token_ids) == len(p.token_starts) == len(p.token_ends) == len(p.loss_mask)
