"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is predicted by a binary logistic classifier on hashed
character n-grams; the language whose codeword costs least under the weighted logistic loss of
the bits wins.  A small lead over the second flags the row as ambiguous.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, held_out, numbered, uniform

DIMENSIONS_BITS, ORDERS = 12, 3
PER_LANGUAGE = 600
UNKNOWN = "und"
#: A text further than this from every codeword (bits that say nothing cost log 2 = 0.69 each) is no language,
#: or several of them; in the latter case bits are sure of contrary things, in the former their outputs are small.
FAR, UNSURE = 0.6, 3.1
_PIECE = 1 << 20


def codewords(languages: int, seed: int = 6) -> np.ndarray:
    """Rows of +1 / -1: every split of up to five languages; else random codes, the best apart of many."""
    if languages <= 5:
        splits = range(1, 1 << max(0, languages - 1))
        bits = [[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in splits] for i in range(languages)]
        return np.array(bits, float).reshape(languages, -1)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(languages) * width
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


def ngram_frequencies(text: str) -> np.ndarray | None:
    """Roots of the shares of hashed n-grams of 1 to 3 characters (length 1); None without letters.

    Letters are lower-cased, other ASCII becomes a blank, blanks are merged.  Long texts are read
    in pieces that overlap as n-grams need.
    """
    if not any(map(str.isalpha, text)):
        return None
    counts = np.zeros(1 << DIMENSIONS_BITS)
    shift = np.uint32(32 - DIMENSIONS_BITS)
    carry = np.array([32], np.uint32)
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
        before = np.concatenate([carry[-1:], codes[:-1]])
        codes = codes[(codes != 32) | (before != 32)]
        line = np.concatenate([carry, codes])
        for order in range(1, ORDERS + 1):
            part = line[max(0, len(carry) - order + 1) :]
            if len(part) < order:
                continue
            h = np.full(len(part) - order + 1, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(order):
                h = (h ^ part[i : len(part) - order + 1 + i]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            counts += np.bincount(h >> shift, minlength=len(counts))
        carry = line[-(ORDERS - 1) :]
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def train_codes(x: np.ndarray, labels: np.ndarray, code: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bias last) of all bit classifiers, and the weight of each bit for each language.

    Rows count such that languages weigh alike.  A bit weighs for a language as much as it is
    right on that language's rows.
    """
    languages, width = code.shape
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    y = code[labels].astype(np.float32)
    each = 1 / np.maximum(np.bincount(labels, minlength=languages), 1)[labels]
    each = (each / each.sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], width), np.float32)
    ahead = w
    for i in range(rounds):  # accelerated gradient; rows have length sqrt 2 at most, so 2 is a safe step
        margin = np.clip(y * (x @ ahead), -30, 30)
        step = ahead + 2.0 * (x.T @ (each * y / (1 + np.exp(margin))) - 1e-6 * ahead)
        ahead = step + (i / (i + 3)) * (step - w)
        w = step
    right = (y * (x @ w) > 0).astype(float)
    trust = np.array([right[labels == i].mean(axis=0) if (labels == i).any() else np.ones(width) for i in range(languages)])
    trust = np.maximum(trust, 1e-3)
    return w, trust / trust.sum(axis=1, keepdims=True)


def decode(x: np.ndarray, w: np.ndarray, code: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted distance of each row to each codeword, and how sure its bits are on average."""
    f = x @ w[:-1] + w[-1]
    losses = np.logaddexp(0, -code[None] * f[:, None, :])
    return (losses * trust[None]).sum(axis=2), np.abs(f).mean(axis=1)


class LanguageModel:
    """Fitted codes; ``languages`` in sorted order."""

    def __init__(self, languages: list[str], code: np.ndarray, w: np.ndarray | None, trust: np.ndarray | None):
        self.languages, self.code, self.w, self.trust = languages, code, w, trust

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Index of the language, score, lead over the second, distance from the nearest codeword and mean output of the bits."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x)), np.zeros(len(x)), np.ones(len(x))
        cost, sure = decode(x, self.w, self.code, self.trust)
        order = np.sort(cost, axis=1)
        share = np.exp(-(cost - order[:, :1]) * self.code.shape[1])
        return cost.argmin(axis=1), share.max(axis=1) / share.sum(axis=1), order[:, 1] - order[:, 0], order[:, 0], sure


def fit_languages(
    docs: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Learn from about ``per_language`` rows of each language, drawn by hash from the rows not held out.

    The driver receives a count per language and the model; the sample meets in one task, whose
    size that bound and the number of languages fix.
    """
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col), lang=F.col(lang_col))
    rows = rows.filter(~held_out("doc_id") & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((len(languages), 0)), None, None)
    code = codewords(len(languages))
    shares = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, per_language / counts[lang]))))
    sample = rows.filter(uniform("doc_id", ROW, seed=seed) < F.element_at(shares, F.col("lang")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, data, key = [], [], []
            for f, r, i, t in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 2))):
                x = ngram_frequencies((t or b"").decode("utf-8", "replace"))
                if x is not None:
                    lang.append(i)
                    data.append(x.tobytes())
                    key.append(f ^ r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(data, pa.binary()), pa.array(key, pa.int64())], names=["lang", "x", "key"]
            )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lang"])
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1)
        labels = pdf["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
        out = io.BytesIO()
        w, trust = train_codes(x, labels, code)
        np.savez(out, w=w, trust=trust)
        return pd.DataFrame({"model": [out.getvalue()]})

    sample = sample.select(FILE, ROW, F.col("text").cast("binary").alias("text"), "lang")
    learned = sample.mapInArrow(features, "lang string, x binary, key long").groupBy().applyInPandas(fit, "model binary").first()
    if learned is None:
        return LanguageModel([], code, None, None)
    model = np.load(io.BytesIO(bytes(learned.model)))
    return LanguageModel(languages, code, model["w"], model["trust"])


def predict_languages(docs: DataFrame, model: LanguageModel, *, lead: float = 0.1, far: float = FAR, unsure_below: float = UNSURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: file and row key, doc_id, held_out, lang_pred, score, ambiguous, distance, rejected.

    ``und`` with score 0 stands for texts that are null or have no letter (and for all rows if no
    language could be learned).  ``distance`` is the weighted loss against the nearest codeword; ``rejected`` says that a
    text has no letter, or is further than ``far`` from every codeword by bits whose mean output is below ``unsure_below``:
    texts that mix languages stay.  If no language could be learned,
    texts with letters have no distance and are not rejected.  ``score`` is the winner's share of exp(-cost); ``ambiguous`` says that
    its weighted loss leads the second's by less than ``lead``.  Repeated rows and null ids are
    rows like any other (a null id is not held out, but never learned from); an empty table gives none.
    """
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col)).select(
        FILE, ROW, "doc_id", held_out("doc_id").alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [ngram_frequencies((t or b"").decode("utf-8", "replace")) for t in part.column(4).to_pylist()]
                pred, score, unsure = [UNKNOWN] * len(found), [0.0] * len(found), [True] * len(found)
                distance, rejected = [None] * len(found), [x is None for x in found]
                known = [i for i, x in enumerate(found) if x is not None and model.languages]
                if known:
                    for i, k, s, a, d, sure in zip(known, *model.predict(np.stack([found[i] for i in known]))):
                        pred[i], score[i], unsure[i] = model.languages[k], float(s), bool(a < lead)
                        distance[i], rejected[i] = float(d), bool(d > far and sure < unsure_below)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in range(4)), pa.array(pred), pa.array(score, pa.float64()), pa.array(unsure),
                        pa.array(distance, pa.float64()), pa.array(rejected),
                    ],
                    names=[FILE, ROW, "doc_id", "held_out", "lang_pred", "score", "ambiguous", "distance", "rejected"],
                )

    return rows.mapInArrow(
        run, f"{FILE} long, {ROW} long, doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean, distance double, rejected boolean"
    )
