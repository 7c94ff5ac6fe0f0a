"""Positional postings, built row by row.

A document is one row, so its equal tokens are merged inside the row: sort the
``(token, position)`` entries, cut them into runs, explode the runs.  The build
is therefore one narrow pass over the documents.  Grouping exploded tokens would shuffle
every token of the corpus only to bring together what already lies together.

``scope`` is ``""`` for a token of the whole document and the field name for a token of
that field; each token is posted under both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, text_arrays
from ..functions.text_arrays import pieces, runs
from ..functions.coerce import let
from ..spec import JSON, Field, IndexSpec
from .typed import once

GLOBAL = ""
# Fixed value: the gap in positions between two fields.
FIELD_GAP = 10


def field_text(value: Column, field: Field) -> Column:
    """The analysable text of a field; of a JSON field only string values."""
    if field.type in JSON:
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return value


def field_tokens(doc: Column, field: Field) -> Column:
    return text.tokens(field_text(doc[field.name], field), field.tokenizer)


def _entries(tokens: Column, field: int, start: Column) -> Column:
    """One entry per token; ``n``, the field's token count, leads to the scoped position."""
    n = F.size(tokens)
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            t.alias("token"),
            (start + i).cast("int").alias("pos"),
            F.lit(field).alias("field"),
            n.alias("n"),
        ),
    )


def _runs(entries: Column, by_field: bool, names: list[str]) -> Column:
    """Sorted entries -> one struct per token (and field) with its positions in order."""
    n = F.size(entries)
    at = F.get

    def differs(i: Column, part: str) -> Column:
        return at(entries, i)[part] != at(entries, i - 1)[part]

    def begins(i: Column) -> Column:
        new = (i == 0) | differs(i, "token")
        return new | differs(i, "field") if by_field and len(names) > 1 else new

    def run(first: Column, end: Column) -> Column:
        members = F.slice(entries, first + 1, end - first)
        head = at(entries, first)
        if by_field:
            scope = at(F.array(*[F.lit(x) for x in names]), head["field"])
            positions = F.transform(members, lambda e: e["pos"] + e["n"])
        else:
            scope, positions = F.lit(GLOBAL), members["pos"]
        return F.struct(scope.alias("scope"), head["token"].alias("token"), positions.alias("positions"))

    return let(
        F.filter(F.sequence(F.lit(0), n - 1), begins),
        lambda s: F.transform(s, lambda first, k: run(first, F.coalesce(at(s, k + 1), n))),
    )


def analysed(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """Rows of ``doc`` plus token arrays ``t0``, ``t1``, ... and their total ``dl``; texts are read once."""
    fields = [f for f in spec.fields if f.has_text]
    kept = [c for c in docs.columns if c != "doc"]
    arrays = [field_tokens(F.col("doc"), f).alias(f"t{i}") for i, f in enumerate(fields)]
    rows = once(docs, kept, arrays) if arrays else docs.select(*kept)
    total = sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0))
    return rows.withColumn("dl", total)


def doc_lengths(docs: DataFrame, spec: IndexSpec, many: bool = False) -> DataFrame:
    """Rows without ``doc`` and with ``dl``, the number of tokens; they are counted, not built.  ``many`` counts in whole Arrow batches."""
    count = (lambda c, t: text_arrays.token_count(docs.sparkSession, c, t)) if many else text.token_count
    counts = [count(field_text(F.col("doc")[f.name], f), f.tokenizer) for f in spec.fields if f.has_text]
    return docs.select(*(c for c in docs.columns if c != "doc"), sum(counts, F.lit(0)).cast("int").alias("dl"))


def postings(docs: DataFrame, spec: IndexSpec, scopes: str = "both") -> DataFrame:
    """``(..., doc)`` to ``(..., scope, token, tf, positions, dl)``.

    Token *i* of a field with *n* tokens stands at ``start + i``, its field-scoped twin at
    ``start + n + i``, and the next field starts ``2 n + 10`` later; a field without
    tokens moves nothing.  ``scopes`` may be ``global`` or ``field`` to post one kind.
    """
    fields = [f for f in spec.fields if f.has_text]
    rows = analysed(docs, spec).filter(F.col("dl") > 0)
    kept = [c for c in docs.columns if c != "doc"]
    if len(fields) == 1:
        return _lone_postings(rows, kept, fields[0].name, scopes)
    if not fields:  # nothing to analyse: no postings
        merged = F.array().cast("array<struct<scope:string,token:string,positions:array<int>>>")
    else:
        start: Column = F.lit(0)
        parts: list[Column] = []
        for i in range(len(fields)):
            n = F.size(f"t{i}")
            parts.append(_entries(F.col(f"t{i}"), i, start))
            start = start + F.when(n > 0, 2 * n + FIELD_GAP).otherwise(0)
        names = [f.name for f in fields]

        def both(entries: Column) -> Column:
            """One sort serves both scopes: fields lie behind each other, so the places of a
            token come in field order."""
            kinds = [k for k in (False, True) if scopes == "both" or (scopes == "field") == k]
            return F.concat(*[_runs(entries, k, names) for k in kinds])

        merged = let(F.sort_array(F.concat(*parts)), both)
    return rows.select(*kept, "dl", F.explode(merged).alias("p")).select(
        *kept, "p.scope", "p.token", F.size("p.positions").alias("tf"), "p.positions", "dl"
    )


def _lone_postings(rows: DataFrame, kept: list[str], name: str, scopes: str) -> DataFrame:
    """:func:`postings` where one field makes up the whole text: its twin of a posting is that posting ``dl`` places on.

    Where runs begin and how long they are is found in the row; runs are cut out after the explode, in compiled code.
    """
    kept = [*kept, "dl"]
    places = F.sequence(F.lit(0), F.size("t0") - 1).alias("at")
    rows = once(rows, kept, [F.sort_array(F.arrays_zip(F.col("t0"), places)).alias("e")])
    rows = once(rows, kept, [F.col("e")["t0"].alias("words"), F.col("e")["at"].alias("places")])
    words, n = F.col("words"), F.size("words")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    runs = let(first, lambda s: F.transform(s, lambda i, k: F.struct(i.alias("at"), (F.coalesce(F.get(s, k + 1), n) - i).alias("tf"))))
    rows = once(rows, [*kept, "words", "places"], [runs.alias("runs")])
    cut = rows.select(*kept, "words", "places", F.explode("runs").alias("r")).select(
        *kept[:-1],
        F.lit(GLOBAL).alias("scope"),
        F.get("words", F.col("r.at")).alias("token"),
        F.col("r.tf").alias("tf"),
        F.slice("places", F.col("r.at") + 1, F.col("r.tf")).alias("positions"),
        "dl",
    )
    if scopes == "global":
        return cut
    named = F.explode(F.array(*(F.lit(x) for x in ([GLOBAL, name] if scopes == "both" else [name]))))
    moved = F.when(F.col("scope") == GLOBAL, F.col("positions")).otherwise(F.transform("positions", lambda p: p + F.col("dl")))
    return cut.select(*kept[:-1], named.alias("scope"), "token", "tf", "positions", "dl").withColumn("positions", moved)


def bulk_postings(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """:func:`postings` under the scope of the document, of ``(docid, doc)`` with one analysed field, in whole Arrow batches.

    For many documents: starting Python takes longer than what a few would save.
    """
    field = next(f for f in spec.fields if f.has_text)
    known = text_arrays.classes(docs.sparkSession, field.tokenizer)
    schema = "docid string, token string, tf int, positions array<int>, dl int"

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known, np.uint8)
        for batch in batches:
            for first, some in pieces(batch.column("text")):
                at, tokens, positions, dl = runs(some, table)
                ids = batch.column("docid").take(pa.array(first + at))
                tf = np.diff(positions.offsets.to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, tokens, pa.array(tf), positions, pa.array(dl.astype(np.int32))], ["docid", "token", "tf", "positions", "dl"]
                )

    rows = docs.select("docid", field_text(F.col("doc")[field.name], field).alias("text")).mapInArrow(posted, schema)
    return rows.select("docid", F.lit(GLOBAL).alias("scope"), "token", "tf", "positions", "dl")


def token_stats(posted: DataFrame) -> DataFrame:
    """Document frequency of each token; combined before the shuffle."""
    return posted.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents and mean token count; documents without tokens count as 0."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_dl"),
    )
