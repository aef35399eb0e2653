import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from quarry.llm import ann, decontam, langid, licenses, passages, pieces, pii, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("score", df[df.columns[0]]).withColumn("lang_x", df[df.columns[0]])


# ── nearest neighbours ───────────────────────────────────────────────────────
def brute_nearest(rows, every, k):
    use = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            use[i] = min(use.get(i, tuple(v)), tuple(v))
    return {q: sorted((math.dist(use[q], v), i) for i, v in use.items() if i != q)[:k] for q in use if q % every == 0}


def test_ann_is_exact_on_small_tables(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0, 2.0]), (None, rows[1][1]), (5, rows[6][1]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.search(spark, df, every=10, k=10).collect()
    want = brute_nearest(rows, 10, 10)
    for q, near in want.items():
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [x[1] for x in mine] == [i for _, i in near]
        assert np.allclose([x[2] for x in mine], [d for d, _ in near], rtol=1e-12)
    assert {x.query_id for x in got} == set(want)


def test_ann_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark, spark.createDataFrame([], schema)).count() == 0
    assert ann.search(spark, spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(spark, spark.createDataFrame([(0, [1.0]), (7, [3.0])], schema)).collect()] == [(0, 1, 7, 2.0)]


def test_ann_recall_and_footrule(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "BLOCK", 3000)
    monkeypatch.setattr(ann, "LEAST", 50)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>")
    got = ann.search(spark, df).toPandas()
    v = v.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.linalg.norm(v - v[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hits / 600 >= 0.9
    pivots, k = v[:40], 12
    block = ann.Block(np.arange(500), v[:500], pivots, k)
    orders = ann.orders(v[:501], pivots, k)
    place = lambda o: {p: i for i, p in enumerate(o)}
    foot = [sum(abs(place(orders[500]).get(p, k) - place(orders[i]).get(p, k)) for p in range(40)) for i in range(500)]
    assert sorted(block.candidates(v[500], 60)) == sorted(sorted(range(500), key=lambda i: (foot[i], i))[:60])


# ── licenses ─────────────────────────────────────────────────────────────────
def test_align_finds_common_order():
    r = random.Random(3)
    for _ in range(100):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 20))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
    assert licenses.align([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and licenses.align([1, 1], [1, 1, 1]) == [(0, 0), (1, 1)]
    for _ in range(100):
        ys = r.sample(range(50), r.randint(0, 12))
        best = max((c for n in range(len(ys) + 1) for c in itertools.combinations(ys, n) if list(c) == sorted(c)), key=len)
        assert len(licenses.rising(list(enumerate(ys)))) == len(best)


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    w = mit.split()
    rows = [(1, "é. Released under the MIT License."), (2, "released under the license"), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0. " * 3), (6, "x " * 5000 + mit.upper().replace(" ", "\n") + " tail"), (7, " ".join(w[:40] + ["changed"] * 12 + w[52:])), (8, "Licensed under CC BY NC 4.0"), (9, "under the bridge, a version of it is licensed")]
    got = defaultdict(list)
    for m in licenses.scan(spark, frame(spark, rows)).collect():
        got[m.doc_id].append((m.license, dict(rows)[m.doc_id][m.start : m.end], m.coverage))
    assert got[1] == [("MIT", "Released under the MIT License", 1.0)] and got[8][0][0] == "CC-BY-NC-4.0"
    assert sorted(x[1] for x in got[5] if x[0] == "Apache-2.0") == ["Licensed under the Apache License, Version 2.0"] * 3
    assert ("MIT-text", 1.0) in [(x[0], x[2]) for x in got[6]] and [x[0] for x in got[7] if x[2] < 1] == ["MIT-text"]
    assert not got[3] and not got[4] and not got[9] and got[2] == [("MIT", "released under the license", 0.8)]


# ── language ─────────────────────────────────────────────────────────────────
def ppm_bits(train, t):
    counts = defaultdict(Counter)
    for x in train:
        b = b"\n\n\n" + x.lower().encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts[b[i - k : i]][b[i]] += 1
    b, bits = b"\n\n\n" + t.lower().encode(), 0.0
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0, None):
            if k is None:
                bits += 8
                break
            c = counts.get(b[i - k : i])
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if c[b[i]]:
                bits -= math.log2(c[b[i]] / total)
                break
            bits -= math.log2(len(c) / total)
    return bits


TRAIN = {"en": ["the cat sat on the mat", "this is that and the other thing"], "de": ["die katze und der hund", "das ist nicht die straße"], "fr": ["le chat est sur la table", "été à la plage"]}


def test_code_lengths_are_exact():
    model = langid.Model(pd.concat([langid.count_grams(pd.DataFrame({"lang": k, "text": v})) for k, v in TRAIN.items()]))
    for t in ("the dog", "über die straße", "漢字 zq", "\n", "the " * 400, "été"):
        assert np.allclose(model.bits([t.lower().encode(), b"x"])[0], [ppm_bits(TRAIN[k], t) for k in model.langs])
    names, scores = model.predict(["this is the thing", None, "", "123 !?", "²³", "nicht das"])
    assert names == ["en", "und", "und", "und", "und", "de"] and all(0 <= s <= 1 for s in scores)


def test_identify(spark):
    rows = [(i, TRAIN[k][i % 2], k) for i, k in enumerate(list(TRAIN) * 20)] + [(900, None, "en"), (901, "", "en"), (902, "12", None), (None, "the cat", "de"), (903, "the cat sat", None)]
    got = {r.doc_id: r for r in langid.identify(spark, frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    import zlib

    for i, t, k in rows[:60]:
        assert got[i].lang_pred == k and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "en"] and got[None].held_out is False
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(spark, empty).count() == 0
    assert langid.identify(spark, spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"
    df = frame(spark, rows, "doc_id long, text string, lang string")
    kept = langid.with_language(spark, df)
    assert kept.columns == df.columns and kept.count() == 62


def test_languages_with_long_documents_only_are_learned(spark):
    rows = [(i, TRAIN[k][i % 2] * (2500 if k == "de" else 1), k) for i, k in enumerate(list(TRAIN) * 20)] + [(500, "1 " * 20_000 + "漢字" * 10_000, "zh"), (501, "die katze" * 4000 + "漢字" * 10_000, "zh")]
    assert min(len(t.encode()) for _, t, k in rows if k in ("de", "zh")) > langid.TRAIN_BYTES
    df = frame(spark, rows, "doc_id long, text string, lang string")
    sample = langid.training_rows(df, 20, langid.TRAIN_BYTES).collect()
    assert {x.lang for x in sample} == {*TRAIN, "zh"} and all(0 < len(x.text.encode()) <= langid.TRAIN_BYTES and langid.has_letter(x.text) for x in sample)
    got = {x.doc_id: x.lang_pred for x in langid.identify(spark, df).collect()}
    assert all(got[i] == k for i, _, k in rows if k == "de")
    # longer ones only fill up
    mixed = [(i, "short text" if i % 2 else "long text " * 4000, "en") for i in range(40)]
    few = langid.training_rows(frame(spark, mixed, "doc_id long, text string, lang string"), 5, langid.TRAIN_BYTES).collect()
    assert [x.text for x in few] == ["short text"] * 5


# ── benchmark passages ───────────────────────────────────────────────────────
def slow_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and free_a[x + n] and free_b[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        if n < least:
            return out
        out.append((x, y, n))
        for i in range(n):
            free_a[x + i] = free_b[y + i] = False


def test_tiles_against_slow_tiles():
    r = random.Random(4)
    for _ in range(150):
        a, b = (np.array([r.randrange(4) for _ in range(r.randint(0, 18))], dtype=np.uint64) for _ in range(2))
        got, want = decontam.tiles(a, b, 3), slow_tiles(a.tolist(), b.tolist(), 3)
        assert [m for _, _, m in got] == [m for _, _, m in want]
        assert sum(m for _, _, m in got) == sum(m for _, _, m in want)


def test_contamination(spark):
    item = " ".join(f"word{i}" for i in range(40))
    w = item.split()
    rows = [(1, f"before. {item} after"), (2, " ".join(w[20:] + ["x"] + w[:20]).upper() + "!"), (3, " ".join(w[:15])), (4, None), (5, ""), (6, " ".join(w[::-1])), (7, f"{item} {item}"), (8, "word1 word2"), (None, item.replace(" ", ", "))]
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "word1 word2"), (10, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.contamination(spark, frame(spark, rows), bench).collect())
    assert got == {(1, 10): 2, (2, 10): 2, (7, 10): 2, (None, 10): 2}
    one = {r.doc_id: r for r in decontam.contamination(spark, frame(spark, rows), bench).collect()}
    assert (one[2].covered, one[2].n_tiles, one[2].coverage) == (40, 2, 1.0)
    df = frame(spark, rows)
    clean = decontam.without_benchmark(spark, df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6, 8}
    assert decontam.without_benchmark(spark, df, bench.limit(0)).count() == 9
    assert decontam.contamination(spark, df.limit(0), bench).count() == 0


def test_contamination_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    got = decontam.contamination(spark, frame(spark, [(i, t) for i, t in items]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(12)]


# ── repeated passages ────────────────────────────────────────────────────────
def brute_repeats(rows, min_words):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        for pos, (_, _, _, norm) in enumerate(passages.units(t or "")):
            first.setdefault(norm, (i, pos))
    out = {}
    for i, t in rows:
        spans, run = [], None
        for pos, (s, e, n, norm) in enumerate(passages.units(t or "")):
            if first[norm] != (i, pos):
                run = (run[0], e, run[2] + n) if run else (s, e, n)
                continue
            spans, run = spans + ([run] if run else []), None
        out[i] = [(s, e) for s, e, n in spans + ([run] if run else []) if n >= min_words]
    return out


def test_passages(spark):
    r = random.Random(5)
    sentence = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(r.randint(2, 14))).capitalize() + "."
    passage = [sentence() for _ in range(8)]
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(6)]
        if i % 2:
            at = r.randrange(6)
            parts[at:at] = [x.upper() if i % 3 else x for x in passage]
        if i % 5 == 0:
            parts.append(passage[0])
        rows.append((i, "".join(p + r.choice([" ", "\n", " \n"]) for p in parts)))
    rows += [(100, None), (101, ""), (102, " \n ")]
    got = {x.doc_id: x for x in passages.remove_repeats(spark, frame(spark, rows)).collect()}
    want = brute_repeats(rows, passages.MIN_WORDS)
    assert {i: [(s.start, s.end) for s in x.removed] for i, x in got.items()} == want
    for i, t in rows:
        assert got[i].n_removed == len(want[i])
        if not want[i]:
            assert got[i].text == t
        else:
            kept = "".join(c for k, c in enumerate(t) if not any(s <= k < e for s, e in want[i]))
            assert got[i].text.split() == kept.split()
    assert sum(passage[2].lower() in re.sub(r"\s+", " ", (x.text or "").lower()) for x in got.values()) == 1
    twice = passages.remove_repeats(spark, spark.createDataFrame([(1, rows[1][1]), (1, rows[1][1])], "doc_id long, text string"))
    assert [x.n_removed for x in twice.collect()] == [0, 0]
    assert passages.remove_repeats(spark, frame(spark, rows).limit(0)).count() == 0


def test_repeated_lines_and_paragraphs_go(spark):
    rows = [
        (1, "Rights are reserved here.\nOne. Two of three.\nfirst own line stays"), (2, "second own line stays\nRIGHTS are  reserved here.\nthe end of two"), (3, "One. Two of three.\nanother line of three\nOne. Two of four."),
        (4, "a b\nc d\n\nown words of four"), (5, "own words of five\n\nA B\nc d\n\na b"), (6, "mixed: Rights are reserved here. inside a line stays"), (7, "Rights are reserved here."), (8, "one two\nsolo eight line"), (9, "one two\nsolo nine line"),
    ]
    kept = {2: "second own line stays\nthe end of two", 3: "another line of three\nOne. Two of four.", 5: "own words of five\na b", 7: ""}
    got = {x.doc_id: x for x in op7_passages_of(spark, rows)}
    assert {i: x.text for i, x in got.items()} == {i: kept.get(i, t) for i, t in rows}
    assert {i: x.n_removed for i, x in got.items() if x.n_removed} == {i: 1 for i in kept}
    assert all(x.text.split() == "".join(c for k, c in enumerate(dict(rows)[i]) if not any(s.start <= k < s.end for s in x.removed)).split() for i, x in got.items())


def op7_passages_of(spark, rows):
    from unittest.mock import patch

    from quarry.llm import queries

    with patch.object(queries, "table", lambda *_: frame(spark, rows)):
        return queries.op7_passages(spark, "").collect()


# ── personal data ────────────────────────────────────────────────────────────
def test_surrogates(spark):
    rows = [
        (1, "Mail Anna.B@mail3.example.com or anna.b@mail3.example.com, call +1 (799) 555-3729 or 799 555 3729."), (2, "card 8316107434564120 and 8316-1074-3456-4120 at 253.10.218.129, v 1.2.3"),
        (3, 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"'), (4, "Mrs. Anna Petrova met Mr. Carl Otto and Mrs. Anna Petrova; г-жа Анна Иванова"), (5, None), (6, ""), (7, "plain text, 12 of 3"), (1, "a@b.co"), (None, "ANNA.B@MAIL3.EXAMPLE.COM"), (8, "x" * 100_000 + " a@b.co"),
    ]
    df = frame(spark, rows)
    out = pii.pseudonymise(spark, df, "k1")
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r.n_entities))
    mail = re.findall(r"\S+@\S+\w", got[1][0][0] if "Mail" in got[1][0][0] else got[1][1][0])
    text1 = next(t for t, _ in got[1] if t.startswith("Mail"))
    assert mail[0].rstrip(",.") == mail[1].rstrip(",.") and re.fullmatch(r"[a-z]{4}\.[a-z]@[a-z]{4}\d\.example\.com", mail[0]) and "anna" not in text1.lower()
    assert got[None] == [(mail[0].upper(), 1)]
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\d{3} \d{3} \d{4}", text1)
    assert len(phones) == 2 and "555" not in phones[0][4:8] + phones[1] or phones
    a, b = re.search(r"card (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}) at (\S+), v 1.2.3", got[2][0][0]).groups()[:2]
    assert a == b.replace("-", "") and a != "8316107434564120"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3][0][0]) and "269b1cea" not in got[3][0][0]
    women, men = pii.NAMES["latin", "f"], pii.NAMES["latin", "m"]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+); г-жа (\w+) (\w+)", got[4][0][0])
    assert m[1] in women and m[3] in men and (m[1], m[2]) == (m[5], m[6]) and m[7] in pii.NAMES["cyrillic", "f"] and m[8] in pii.LAST["cyrillic"]
    assert got[5] == [(None, 0)] and got[6] == [("", 0)] and got[7] == [("plain text, 12 of 3", 0)] and got[8][0][0].endswith(next(t for t, _ in got[1] if "Mail" not in t))
    assert sorted(map(str, pii.pseudonymise(spark, df, "k1").collect())) == sorted(map(str, out.collect())) != sorted(map(str, pii.pseudonymise(spark, df, "k2").collect()))
    assert pii.pseudonymise(spark, df.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr. Name{chr(97 + i % 26)}{chr(97 + i // 26)} wrote; Mrs. Ab{chr(97 + i % 26)} too; 10.0.{i % 9}.{i}; {chr(97 + i % 26)}@x.co") for i in range(200)]
    plain = [(i, re.sub(r"Name(\w+)", lambda m: "N" + m[1], t)) for i, t in rows]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark, frame(spark, plain)).collect()}
    find = lambda t: re.findall(r"(?<=Mr\. )\S+|(?<=Mrs\. )\S+|\d+\.\d+\.\d+\.\d+|\S+@\S+", t)
    pairs = {(a, b) for i, t in plain for a, b in zip(find(t), find(got[i]))}
    old, new = {a for a, _ in pairs}, {b for _, b in pairs}
    assert len(pairs) == len(old) == len(new) and not old & new


# ── pieces ───────────────────────────────────────────────────────────────────
def viterbi(codec, text):
    if not text:
        return []
    t = " " + text
    best, way = [0.0] + [-math.inf] * len(t), [None] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - codec.longest), end):
            p = codec.pieces.get(t[start:end])
            if p and best[start] + p[1] > best[end]:
                best[end], way[end] = best[start] + p[1], (start, [p[0]])
        if t[end - 1] not in codec.pieces and best[end - 1] + codec.unknown > best[end]:
            best[end], way[end] = best[end - 1] + codec.unknown, (end - 1, [codec.byte[b] for b in t[end - 1].encode()])
    out, at = [], len(t)
    while at:
        at, ids = way[at]
        out = ids + out
    return out


TEXTS = ["", " ", "  a b\n\tc ", "▁x ▁", "\x00é漢字😀 aaaa" + "a" * 700, "The end.", "ﬁ  " * 30, "abc" * 2000, "\n\n", "<s> </s> <0x41>"]


@pytest.fixture(scope="module")
def codecs():
    small = [(p, -float(i), "piece") for i, p in enumerate("a b c ab bc abc cab ▁ ▁a ▁ab c▁a b▁ bca".split())]
    small += [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return [pieces.Codec(pieces.load_vocabulary(MODEL)), pieces.Codec(small)]


def test_streaming_search(codecs):
    r = random.Random(6)
    for codec in codecs:
        for t in TEXTS + ["".join(r.choice("abc ") for _ in range(r.randint(1, 300))) for _ in range(60)]:
            want = viterbi(codec, t)
            assert codec.encode(t).tolist() == want
            assert codec.decode(want) == t
            out, parts = [], []
            if t:
                codec.search(" " + t, lambda ids: (out.extend(ids), parts.append(ids)))
                assert out == want


def test_encode_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "x")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in pieces.encode_documents(spark, df, MODEL).collect()}
    assert all(r.round_trip for i, r in got.items() if i != 99) and got[99].ids is None and got[99].n_ids is None and got[0].ids == []
    assert pieces.encode_documents(spark, df.limit(0), MODEL).count() == 0
    encode, decode = pieces.encoder(spark, MODEL)
    back = df.select("doc_id", "text", decode(encode("text")).alias("again"))
    assert all(r.text == r.again for r in back.collect())


def test_bare_words():
    flat, cuts = words.word_hashes([b"The MIT-License, v2.", b"the mit license v2", "é è".encode()], bare=True)
    assert np.array_equal(flat[:4], flat[4:8]) and list(cuts) == [0, 4, 8, 10]
