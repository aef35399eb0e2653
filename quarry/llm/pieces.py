"""Encoding with a SentencePiece vocabulary by a streaming Viterbi search, and decoding.

The encoding of a text is the sequence of pieces with the largest sum of scores that spells it, after a space is put in front
and spaces become U+2581; a character in no piece falls back to the pieces of its UTF-8 bytes. (A U+2581 in a text does too, so
that decoding gives back every text.) Of equal sums the longer last piece wins.

The search keeps the best sum and the way back for the last boundaries only, as many as the longest piece has characters. Where the
ways back from all boundaries that a later piece can still start from run through one boundary, the pieces before that are final:
they are given out and forgotten. Boundaries that no piece can cross are such places whatever the text; texts are cut there
first, and what was found for a short cut is kept for its next occurrence.
"""

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import BATCH_ROWS

SPACE = "▁"
#: Cuts of up to so many characters are kept, and so many of them, before all are forgotten.
KEEP_CHARS, KEEP = 48, 1_000_000


def load_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """piece, score and kind (piece, byte, other) of a SentencePiece model file. The file is read on the driver only."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Codec:
    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.pieces = {p.replace(SPACE, " "): (i, s) for i, (p, s, kind) in enumerate(vocabulary) if kind == "piece" and p}
        self.byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.begin: dict[str, tuple] = {p[:k]: (None, 0.0) for p in self.pieces for k in range(1, len(p))}
        self.begin |= {p: ((i,), score) for p, (i, score) in self.pieces.items()}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - 10.0
        self.spell = [(p.replace(SPACE, " ").encode() if kind == "piece" else bytes([int(p[3:-1], 16)]) if kind == "byte" else b"") for p, _, kind in vocabulary]
        inner = {c for p in self.pieces if len(p) > 1 for c in p}
        words = "".join(map(re.escape, sorted(inner - {" "})))
        if any(re.search("[^ ] ", p) for p in self.pieces):  # pieces over a word's end
            self.cut = re.compile(f"[ {words}]+|.", re.DOTALL)
        else:
            self.cut = re.compile(f" *[{words}]+| +|." if words else " +|.", re.DOTALL)
        self.known: dict[str, bytes] = {}

    def search(self, text: str, emit) -> None:
        """Gives emit() the ids of a text; holds no more than the window and what isn't final."""
        begin, longest, n, unknown = self.begin, self.longest, len(text), self.unknown
        done, best, back = 0, [0.0], [None]  # of the boundaries from done on: the best sum, the boundary before and the ids between
        for start in range(n):
            here = best[start - done]
            for end in range(start + 1, min(n, start + longest) + 1):
                if end - done == len(best):
                    best.append(-np.inf)
                    back.append(None)
                found = begin.get(text[start:end])
                if found is None:  # no piece begins like this
                    break
                if found[0] is not None and here + found[1] > best[end - done]:
                    best[end - done], back[end - done] = here + found[1], (start, found[0])
            if here + unknown > best[start + 1 - done] and text[start] not in self.pieces:
                best[start + 1 - done], back[start + 1 - done] = here + unknown, (start, tuple(self.byte[b] for b in text[start].encode()))
            if start % longest == longest - 1 or start == n - 1:
                # The ways back from all boundaries that a piece can start from, the latest first, until one boundary is left.
                alive = {x + done for x in range(start + 1 - done, len(best)) if back[x]} if start < n - 1 else {n}
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(back[last - done][0] if last > done else done)
                meet = alive.pop()
                at, way = meet, []
                while at > done:
                    at, ids = back[at - done]
                    way.append(ids)
                for ids in reversed(way):
                    emit(ids)
                del best[: meet - done], back[: meet - done]
                done = meet

    def part(self, text: str) -> bytes:
        ids = array("i")
        self.search(text, ids.extend)
        if len(text) <= KEEP_CHARS:
            if len(self.known) >= KEEP:
                self.known.clear()
            self.known[text] = ids.tobytes()
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """ids as 32-bit numbers; none for an empty text."""
        known, part = self.known, self.part
        cuts = self.cut.findall(" " + text) if text else []
        return np.frombuffer(b"".join([known.get(c) or part(c) for c in cuts]), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; ids of no text (control pieces) are left out. Bytes that aren't UTF-8 become U+FFFD."""
        spell = self.spell
        return b"".join([spell[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


class Vocabulary:
    """What is broadcast. A worker makes the codec once and uses it, with the cuts it knows, in all its tasks."""

    def __init__(self, path: str):
        self.pieces, self.made = load_vocabulary(path), None

    def codec(self) -> Codec:
        if self.made is None:
            self.made = Codec(self.pieces)
        return self.made


def encoder(spark: SparkSession, model_path: str):
    """Column functions encode(text) to array<int> and decode(ids) to string; null stays null. The vocabulary is broadcast."""
    shared = spark.sparkContext.broadcast(Vocabulary(model_path))

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        c = shared.value.codec()
        return pd.Series([c.encode(t) if isinstance(t, str) else None for t in text], dtype=object)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        c = shared.value.codec()
        return pd.Series([None if x is None else c.decode(x.tolist() if hasattr(x, "tolist") else x) for x in ids], dtype=object)

    return encode, decode


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (decoding gives the text). A null text has null in all three, an empty one no ids."""
    shared = spark.sparkContext.broadcast(Vocabulary(model_path))

    def run(batches):
        import pyarrow as pa

        from .words import chunks

        codec = shared.value.codec()
        for batch in (whole.slice(k, BATCH_ROWS) for whole in batches for k in range(0, whole.num_rows, BATCH_ROWS)):
            texts = batch.column(1).to_pylist()
            for a, z in chunks([t or "" for t in texts], 8 << 20):
                ids = [None if t is None else codec.encode(t) for t in texts[a:z]]
                same = [None if t is None else codec.decode(x.tolist()) == t for t, x in zip(texts[a:z], ids)]
                n = [0 if x is None else len(x) for x in ids]
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                mask = pa.array([x is None for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat, pa.int32()), mask=mask)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), lists, pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")
