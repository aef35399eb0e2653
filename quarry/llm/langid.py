"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes. A byte costs -log2 n / (N + D) bits in the longest context that
the language knows, where the context was seen N times with D different next bytes and n times with this one. If the byte never
followed there, an escape of -log2 D / (N + D) bits leads to the next shorter context; below the empty one all 256 bytes cost
the same. Statistics are frozen after learning, so the code length of a whole text is a sum over its bytes, taken from
tables. The language with the shortest code wins; score is its share of the probabilities 2 ** -bits of all.

Texts are lower-cased and start in the context of three line feeds.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import BATCH_ROWS

PAD = b"\n\n\n"
#: The sample that is learned from: so many documents of each language, those with the smallest hash of doc_id. Longer ones only
#: fill it up where a language has too few others, each with at most so many bytes from its first letter on.
TRAIN_DOCS, TRAIN_BYTES = 300, 32768
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    """crc32 of doc_id as text is 0 modulo 5; false for a null doc_id, whose row is not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m.group())) for m in _WORD.finditer(text))


def training_rows(docs: DataFrame, per_language: int, max_bytes: int) -> DataFrame:
    """lang, text of the sample; each language has one. The choice runs over narrow rows and keeps per_language of each task before
    the shuffle."""
    can = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    long = F.octet_length("text") > max_bytes
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    chosen = can.select("doc_id", "lang", long.alias("long")).withColumn("__rank", rank).where(F.col("__rank") <= per_language).select("doc_id", "lang").distinct()
    part = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_bytes // 4 - 1}}}", 0)  # a character has four bytes at most
    return can.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi").select("lang", F.when(long, part).otherwise(F.col("text")).alias("text"))


def count_grams(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of all runs of 1 to 4 bytes that end in a byte of the texts, as numbers in base 256."""
    out, parts = [], {k: [] for k in range(4)}
    for text in group.text:
        b = np.frombuffer(PAD + text.lower().encode(), dtype=np.uint8).astype(np.int64)
        gram = np.zeros(len(b) - 3, np.int64)
        for k in range(4):
            gram = gram + (b[3 - k : len(b) - k] << (8 * k))
            parts[k].append(gram)
    for k, grams in parts.items():
        g, n = np.unique(np.concatenate(grams), return_counts=True)
        out.append(pd.DataFrame({"lang": group.lang.iloc[0], "k": k, "gram": g, "n": n}))
    return pd.concat(out)


class Model:
    """Tables of code lengths, one column a language."""

    def __init__(self, counts: pd.DataFrame):
        """counts: lang, k (length of the context), gram (context and byte), n."""
        self.langs = sorted(counts.lang.unique())
        if not self.langs:
            return
        wide = {k: counts[counts.k == k].pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=self.langs, fill_value=0) for k in range(4)}
        # The contexts of three bytes have numbers among the triples, also those that begin in the three line feeds.
        wide[2] = wide[2].reindex(np.union1d(wide[2].index.to_numpy(np.int64), wide[3].index.to_numpy(np.int64) >> 8), fill_value=0)
        many = len(self.langs)
        cost, self.escape = np.full((256, many), 8.0), [None] * 4
        grams, below = [None] * 4, None
        for k in range(4):
            g, n = wide[k].index.to_numpy(np.int64), wide[k].to_numpy(np.float64)
            context, place = np.unique(g >> 8, return_inverse=True)
            total, kinds = np.zeros((len(context), many)), np.zeros((len(context), many))
            np.add.at(total, place, n)
            np.add.at(kinds, place, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = np.log2(total[place] + kinds[place]) - np.log2(n)
            if k == 0:
                lower, all_g = cost, np.arange(256, dtype=np.int64)
                table = lower + escape[0]
            elif k == 1:
                all_g = np.arange(65536, dtype=np.int64)
                table = below[all_g & 255].copy()
                esc = np.zeros((256, many))
                esc[context] = escape
                table += esc[all_g >> 8]
                self.escape[1] = esc
            else:
                all_g = g
                short = g & ((1 << (8 * k)) - 1)  # a byte's run without its first byte was counted too
                table = below[short if k == 2 else np.searchsorted(grams[2], short)] + escape[place]
            rows = g if k < 2 else slice(None)
            table[rows] = np.where(n > 0, seen, table[rows])
            grams[k], below = all_g, table
            if k >= 2:
                self.escape[k] = (context, escape)
            setattr(self, f"cost{k}", table)
        # Numbers for the runs that were seen, 0 for any other: pairs, then triples and quadruples by the number of what precedes.
        pairs = np.unique(np.r_[grams[2] >> 8, grams[2] & 65535])
        self.pair = np.zeros(65536, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.triple = np.zeros((len(pairs) + 1) * 256, np.int32)
        self.triple[self.pair[grams[2] >> 8].astype(np.int64) * 256 + (grams[2] & 255)] = np.arange(1, len(grams[2]) + 1)
        self.kind = np.zeros(256, np.int64)
        kinds = np.unique(grams[3] & 255)
        self.kind[kinds] = np.arange(1, len(kinds) + 1)
        self.kinds = len(kinds) + 1
        self.quad = np.zeros((len(grams[2]) + 1) * self.kinds, np.int32)
        self.quad[(np.searchsorted(grams[2], grams[3] >> 8) + 1) * self.kinds + self.kind[grams[3] & 255]] = np.arange(1, len(grams[3]) + 1)
        first = np.zeros((1, many))
        self.cost2, self.cost3 = np.r_[first, self.cost2], np.r_[first, self.cost3]
        for k, places in ((2, 65536), (3, len(grams[2]) + 1)):
            context, escape = self.escape[k]
            full = np.zeros((places, many))
            full[context if k == 2 else np.searchsorted(grams[2], context) + 1] = escape
            self.escape[k] = full

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text in each language."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        b = np.frombuffer(b"".join(PAD + t for t in texts), dtype=np.uint8).astype(np.int64)
        pair = np.r_[0, (b[:-1] << 8) + b[1:]]
        known = self.pair[pair].astype(np.int64)
        triple = np.r_[0, self.triple[known[:-1] * 256 + b[1:]]].astype(np.int64)
        quad = np.r_[0, self.quad[triple[:-1] * self.kinds + self.kind[b[1:]]]]
        cost = self.cost3[quad]
        miss = np.flatnonzero(quad == 0)
        miss = miss[miss >= 3]
        cost[miss] = self.escape[3][triple[miss - 1]]
        has = triple[miss] > 0
        cost[miss[has]] += self.cost2[triple[miss[has]]]
        low = miss[~has]
        cost[low] += self.escape[2][pair[low - 1]] + self.cost1[pair[low]]
        starts = np.r_[0, np.cumsum([len(t) + 3 for t in texts])[:-1]]
        for i in range(3):
            cost[starts + i] = 0
        return np.add.reduceat(cost, starts, axis=0)

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if isinstance(t, str) and self.langs and has_letter(t)]
        from .words import chunks

        raw = [texts[i].lower().encode() for i in use]
        for a, z in chunks(raw, max(1 << 14, (1 << 20) // max(4, len(self.langs)))):
            bits = self.bits(raw[a:z])
            best = bits.argmin(axis=1)
            share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            for i, w, s in zip(use[a:z], best, 1 / share.sum(axis=1)):
                names[i], scores[i] = self.langs[w], s
        return names, scores


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Only the counts of the bounded sample reach the driver: of at most per_language * max_bytes bytes a language."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = training_rows(docs, per_language, max_bytes)
    return Model(sample.groupBy("lang").applyInPandas(count_grams, "lang string, k int, gram long, n long").toPandas())


def predictor(spark: SparkSession, model: Model):
    """A column function: text to struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        parts = [shared.value.predict(list(text.iloc[k : k + BATCH_ROWS])) for k in range(0, len(text), BATCH_ROWS)]
        return pd.DataFrame({"lang": [x for names, _ in parts for x in names], "score": np.concatenate([np.zeros(0), *(s for _, s in parts)])})

    return predict


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row. Learns from rows that aren't held out and have doc_id, lang and a letter.
    A null text or one without a letter, and every text if there is nothing to learn from, is `und` with score 0. Equal code
    lengths go to the first language by name."""
    predict = predictor(spark, learn(docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_language(spark: SparkSession, docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least this score."""
    return docs.where(predictor(spark, learn(docs))(F.col("text").cast("string")).score >= min_score)
