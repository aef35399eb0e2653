"""Repeated passages by hashing normalised units.

A text falls into units: its lines, and within a line the sentences (passages may start and end inside a line). A unit is
normalised (lower case, runs of white space as one space) and hashed to 128 bits; digests are grouped over all documents. The
earliest occurrence by doc_id and place stays. Later ones go where they are a whole line or paragraph (lines up to an empty one)
of at least LINE_WORDS words. Sentences inside a line go where they stand in an unbroken run of repeated units with at least
MIN_WORDS words, so a short sentence that happens to occur twice within lines stays where it is. The spans that went are kept as
offsets into the original text.
"""

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch

MIN_WORDS, LINE_WORDS = 25, 3
_BETWEEN = re.compile(r"\s*\n\s*|(?<=[.!?])\s+")


def units(text: str):
    """start, end, words and normalised text of the units with a word, in order."""
    at = 0
    for m in [*_BETWEEN.finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[at:end].lower().split()
        if words:
            yield at, end, len(words), " ".join(words)
        at = m.end() if m else end


def places(text: str, min_words: int, line_words: int | None):
    """pos, until (the first and the last unit), start, end, words, whole (an entire line or more) and normalised text: of each
    unit, and of lines and paragraphs of several units with line_words or more. Those with min_words are left out, as their units
    are a run that is long enough."""
    found = list(units(text))
    line, paragraph, lines = 0, 0, []
    for k, (start, end, n, norm) in enumerate(found):
        breaks = text.count("\n", end, found[k + 1][0]) if k + 1 < len(found) else 2
        yield k, k, start, end, n, breaks > 0 and line == k, norm
        if not breaks:
            continue
        lines.append(" ".join(x[3] for x in found[line : k + 1]))
        for first, whole in ((line, lines[-1:]), (paragraph, lines))[: 2 if breaks > 1 and paragraph < line else 1]:
            words = sum(x[2] for x in found[first : k + 1])
            if first < k and line_words is not None and line_words <= words < min_words:
                yield first, k, found[first][0], end, words, True, "\n".join(whole)
        line = k + 1
        if breaks > 1:
            paragraph, lines = k + 1, []


def unit_rows(docs: DataFrame, min_words: int, line_words: int | None) -> DataFrame:
    """doc_id, text_key, pos, until, start, end, n_words, whole, a, b (the digest) for each of places()."""

    def run(batches):
        for batch in batches:
            rows, digests = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for *at, norm in places(text or "", min_words, line_words):
                    rows.append((row, *at))
                    digests.append(hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if len(rows) > 200_000:
                    yield batch_of(batch, rows, digests)
                    rows, digests = [], []
            yield batch_of(batch, rows, digests)

    def batch_of(batch, rows, digests):
        import pyarrow as pa

        r = np.array(rows, dtype=np.int64).reshape(-1, 7)
        d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        take = pa.array(r[:, 0])
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(r[:, i].astype(np.int32)) for i in range(1, 6)), pa.array(r[:, 6] > 0), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["doc_id", "text_key", "pos", "until", "start", "end", "n_words", "whole", "a", "b"])

    return docs.mapInArrow(run, "doc_id long, text_key long, pos int, until int, start int, end int, n_words int, whole boolean, a long, b long")


def spans_to_remove(min_words: int, line_words: int | None):
    """doc_id, text_key, seen (the repeated places of a text, sorted) to doc_id, text_key, removed (start, end): whole lines and
    paragraphs with line_words, and unbroken runs of units with min_words; spans that touch are one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            pos, until, start, end, n, whole = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            unit = pos == until
            at = text[unit] << 32 | pos[unit]
            words = np.bincount(np.cumsum(np.diff(at, prepend=-2) != 1), n[unit])
            go = words[np.cumsum(np.diff(at, prepend=-2) != 1)] >= min_words
            if line_words is not None:
                go |= whole[unit] & (n[unit] >= line_words)
                low, high = (np.searchsorted(at, text[~unit] << 32 | x[~unit], side) for x, side in ((pos, "left"), (until, "right")))
                for a, b in zip(low, high):
                    go[a:b] = True
            at, start, end, text = at[go], start[unit][go], end[unit][go], text[unit][go]
            new = np.diff(at, prepend=-2) != 1
            last = np.r_[new[1:], True] if len(new) else new
            ids, sizes = np.unique(text[new], return_counts=True)
            spans = pa.StructArray.from_arrays([pa.array(start[new], pa.int32()), pa.array(end[last], pa.int32())], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), batch.column(1).take(pa.array(ids)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), spans)], ["doc_id", "text_key", "removed"])

    return run


def cut(text: str, spans) -> str:
    """The text without the spans. What stands between units goes with them, but what is left is never run together."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    kept = out[0]
    for part in out[1:]:
        gap = part[: len(part) - len(part.lstrip())]
        rest = part[len(gap) :]
        kept = kept if kept.strip() else ""
        if not rest:
            continue
        kept = kept.rstrip() + ("\n" if "\n" in gap or kept[len(kept.rstrip()) :].count("\n") else gap or " ") + rest if kept else rest
    return kept if kept.strip() or not text.strip() else ""


def repeated_spans(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """doc_id, text_key, removed (array of start, end) of the texts that lose something."""
    found = unit_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''"), min_words, line_words)
    scratch = Scratch(spark, "passages")
    place = F.struct("doc_id", "text_key", "pos")
    twice = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "first")
    twice = scratch.save(twice, "twice")
    later = found.join(twice, ["a", "b"]).where(place > F.col("first")).select("doc_id", "text_key", "pos", "until", "start", "end", "n_words", "whole")
    # At most the places of one text meet here.
    seen = later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("pos", "until", "start", "end", "n_words", "whole")))).alias("seen"))
    return seen.mapInArrow(spans_to_remove(min_words, line_words), "doc_id long, text_key long, removed array<struct<start: int, end: int>>")


def text_key():
    return F.xxhash64(F.col("text").cast("string")).alias("text_key")


def remove_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, line_words: int | None = None) -> DataFrame:
    """doc_id, text (what is left), n_removed, removed (spans of the original text) for each row.

    Without line_words lines count as any other unit; the query gives LINE_WORDS.
    Null and empty texts come back as they are. Occurrences rank by doc_id (null first), then a hash of the text, then place; rows
    equal in doc_id and text are one document, each gets its result. A text may lose all its units and is then empty."""
    spans = Scratch(spark, "spans").save(repeated_spans(spark, docs, min_words, line_words), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key())
    on = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["text_key"] == spans["text_key"])

    @F.pandas_udf("string")
    def without(text, removed):
        import pandas as pd

        return pd.Series([t if r is None or t is None else cut(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(text, removed)], dtype=object)

    joined = rows.join(spans, on, "left").select(rows["doc_id"], "text", "removed")
    kept = F.coalesce("removed", F.expr("cast(array() as array<struct<start: int, end: int>>)"))
    return joined.select("doc_id", without("text", "removed").alias("text"), F.size(kept).alias("n_removed"), kept.alias("removed"))
