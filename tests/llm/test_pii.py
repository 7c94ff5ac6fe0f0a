import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm.pii import find_personal_data, fit_spans
from folioseek.llm.pii_spans import KINDS, SpanModel, Taken, base_spans, candidates, luhn

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_against_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["@", ".", "+", "1", "23", "255", "256", " ", "-", "a", "b.c", "(", ")", "4539578763621486", "é", "+49 30", "007"]
    for _ in range(30_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert plain(t) == base_spans(t)


def test_long_runs_take_linear_time():
    for piece in ("a", "1", "1.", "@", "+1", "+1 ", "a@", "1 "):
        base_spans(piece * 100_000)


def test_taken():
    rng = random.Random(3)
    for _ in range(300):
        taken, kept = Taken(), []
        for _ in range(30):
            s = rng.randrange(60)
            e = s + rng.randint(1, 6)
            assert taken.meets(s, e) == any(s < b and a < e for a, b in kept)
            if not taken.meets(s, e):
                taken.add(s, e)
                kept.append((s, e))


@pytest.fixture(scope="module")
def model(spark):
    return fit_spans(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_documents(spark, model):
    rows = [
        (1, None), (2, ""), (3, "mail a.b@c.de or +49 (30) 123-4567 ü 10.0.0.1 and 4539 5787 6362 1486"),
        (4, "call me on (499) 555-6503 today"), (5, "release 2019-10-14, order 5927243074273351, version 3."), (None, "x" * 300_000 + " q@w.e"), (3, "mail a.b@c.de"),
    ]
    new = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    got = find_personal_data(new, model).collect()
    assert len(got) == len(rows)
    assert sum(r.n_email for r in got) == 3
    # The plain patterns take the square of a long text's time; its one span is known.
    bases = [(i, [(0, 300_001, 300_006)] if len(t or "") > 10_000 else plain(t or "")) for i, t in rows]
    for r in got:
        for i, base in bases:
            line = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
            if r.doc_id == i and r.base_sha256 == hashlib.sha256(line.encode()).hexdigest():
                assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
                break
        else:
            raise AssertionError(r)
    assert {r.doc_id: r.spans for r in got}[4] == "phone:11:25" and {r.doc_id: r.n_added for r in got}[5] == 0
    assert find_personal_data(new, None).agg(F.sum("n_added")).first()[0] == 0
    assert fit_spans(new.limit(1)) is None and find_personal_data(new.limit(0), model).count() == 0


def test_candidates_inside_runs_of_numbers():
    for left, gap, right in [
        ("(212) 555-0199", ", ", "(213) 555-0188"), ("212-555-0199", " / ", "213-555-0188"), ("10001", " ", "(212) 555-0199"),
        ("2024-01-02", ", ", "212-555-0199"), ("4539.5787.6362.1486", " ", "4539.5787.6362.1486"), ("10.0.0.1", ", ", "212-555-0199"),
    ]:
        found = {c[1:] for c in candidates(left + gap + right)}
        ends = len(left), len(left) + len(gap)
        assert (ends[1], ends[1] + len(right)) in found and (len(left) < 7 or (0, ends[0]) in found)
    assert {(1, 3, 17)} <= set(candidates("5. 10[.]0[.]0[.]1"))
    rng = random.Random(5)
    for _ in range(2_000):
        t = "".join(rng.choice(["1", "22", "333", "55555", ", ", " (", ") ", "-", "x", "    "]) for _ in range(rng.randint(1, 16)))
        want = set()
        for a in (m.start() for m in re.finditer("(?<![0-9])[0-9]", t)):
            for b in (m.end() for m in re.finditer("[0-9](?![0-9])", t)):
                n = len(re.sub("[^0-9]", "", t[a:b]))
                if b > a and re.fullmatch(r"[0-9]+([ (),-]{1,3}[0-9]+)*", t[a:b]) and 7 <= n <= 19:
                    want |= {(k, a - (t[:a].endswith("(")), b) for k in (2, 3) if (13 <= n if k == 2 else n <= 15)}
        assert {c for c in candidates(t) if c[0] > 1} == want


def test_neighbouring_numbers(model):
    found = lambda t: sorted(t[s:e] for _, s, e in model.extra(t, base_spans(t)))
    one, two, card = "(212) 555-0199", "(213) 555-0188", "4539.5787.6362.1486"
    assert found(f"call {one}, {two} today") == [one, two]
    assert found("call 212-555-0199 / 213-555-0188 today") == ["212-555-0199", "213-555-0188"]
    assert found(f"New York, NY 10001 {one} today") == [one]
    assert found("on 2024-01-02, 212-555-0199 today") == ["212-555-0199"]
    assert found(f"pay {card} {card} today") == [card, card]


def test_planted_spans_are_added(model):
    """Formats beyond the base ones, between words no text of the table has, and numbers that are nothing personal."""
    rng = random.Random(12)
    digits = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    wide = {
        "phone": lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "email": lambda: rng.choice([f"{word()} [at] {word()} [dot] com", f"{word()}.{word()} (at) {word()}.org"]),
    }
    for kind, make in wide.items():
        met = 0
        for _ in range(100):
            span = make()
            t = f"{word()} {word()} call or write {span} {word()} {word()}."
            start = t.index(span)
            met += (KINDS.index(kind), start, start + len(span)) in model.extra(t, base_spans(t))
        assert met >= 80, (kind, met)
    plainly = [f"{word()} {word()} {rng.randint(1, 999)} {word()}, {rng.randint(1900, 2030)} {word()} {rng.random():.3f} {word()}" for _ in range(300)]
    assert sum(bool(model.extra(t, base_spans(t))) for t in plainly) <= 3


def test_a_text_is_learned_or_checked_never_both():
    """Labels are noise that only a text's own rows share: checked on other texts they hold nowhere, so nothing may be added."""
    rng = np.random.default_rng(4)
    texts = np.repeat(np.arange(300), 8)
    x = np.column_stack([np.zeros(len(texts)), rng.random(300)[texts]])
    y = rng.integers(0, 2, 300)[texts].astype(float)
    assert SpanModel(x, y, texts, 0.999, 8).threshold == [2.0] * 4
