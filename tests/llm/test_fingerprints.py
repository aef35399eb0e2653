import hashlib
import random

import pytest

from quarry.llm import fingerprints as fp


def some_text(rng, n):
    return "".join(rng.choice("ab cdeé語😀\n") for _ in range(n))


def test_spans_and_extensions_as_by_comparing(monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 7)
    fp._powers.clear()
    rng = random.Random(1)
    a = some_text(rng, 60)
    b = some_text(rng, 5) + a[10:45] + some_text(rng, 9)
    x, y = fp.Prefixes(a), fp.Prefixes(b)
    for _ in range(400):
        i, j, n = rng.randrange(60), rng.randrange(len(b)), rng.randrange(12)
        if i + n <= x.n and j + n <= y.n:
            assert x.same(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        right = next((k for k in range(100) if i + k >= x.n or j + k >= y.n or a[i + k] != b[j + k]), 0)
        left = next((k for k in range(100) if i - k <= 0 or j - k <= 0 or a[i - k - 1] != b[j - k - 1]), 0)
        assert (x.common(i, y, j), x.common_before(i, y, j)) == (right, left)
    spans = x.spans(3, 50).tolist()
    assert [(u == v) for u in spans for v in spans] == [(a[i : i + fp.SPAN] == a[j : j + fp.SPAN]) for i in range(3, 50 - fp.SPAN + 1) for j in range(3, 50 - fp.SPAN + 1)]
    fp._powers.clear()


def brute_fingerprint(text):
    """Without prefix sums: each run's polynomial by itself."""
    poly = lambda s: tuple(sum((ord(c) + 1) * pow(fp.BASE, j, p) for j, c in enumerate(s)) % p for p in fp.PRIMES)
    length, least = min(fp.SPAN, len(text)), {}
    mask = (1 << 64) - 1
    for i in range(len(text) - length + 1 if text else 0):
        u, v = poly(text[i : i + length])
        h = ((u << 31 | v) + 0x9E3779B97F4A7C15) & mask
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
        h ^= h >> 31
        least[h >> 58] = min(h, least.get(h >> 58, h))
    u, v = poly(text)
    return f"{len(text):x}-{u:08x}{v:08x}-" + "".join(f"{least[b] % 65535 + 1 if b in least else 0:04x}" for b in range(fp.BINS))


def brute(rows):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint of rows in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(text), brute_fingerprint(edited)))
    return out


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_each_document_and_the_next(spark, blocks):
    rng = random.Random(blocks)
    texts = [some_text(rng, rng.choice([0, 1, 5, 11, 12, 30, 200])) for _ in range(50)]
    texts[7] = texts[8] = texts[20]
    rows = [(None if i == 3 else i * 7 % 50 - 10, None if i == 4 else t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, block int").repartition(4)
    got = fp.compare_with_next(frame, blocks).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(order), key=str)
    by_id = {d: t for d, t in order}
    ids = [d for d, _ in order]
    for r in got:
        own, nxt = by_id[r.doc_id], by_id[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(brute_fingerprint(own), brute_fingerprint(nxt))
        shared = next((k for k in range(300) if k >= min(len(own), len(nxt)) or own[k] != nxt[k]))
        assert r.common_prefix == shared


def test_repeated_rows_one_row_and_none(spark):
    form = "doc_id long, text string"
    same = [(5, "once more the same words")] * 9 + [(5, "others"), (4, None)]
    got = fp.compare_with_next(spark.createDataFrame(same, form), 4).collect()
    assert len(got) == 11 and len({r.fingerprint for r in got if r.n_chars == 24}) == 1
    assert sum(r.near_next == 1 for r in got if r.n_chars == 24) == 8
    one = fp.compare_with_next(spark.createDataFrame([(1, "alone here")], form)).first()
    assert (one.near_next, one.common_prefix, one.edited_sha256) == (1.0, 10, hashlib.sha256(b"alonealone").hexdigest())
    assert fp.compare_with_next(spark.createDataFrame([], form)).count() == 0


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(3)
    a, b = some_text(rng, 3_000_000), some_text(rng, 3000)
    x = fp.Printed(a)
    assert fp.likeness(x.fingerprint, fp.Printed(b).fingerprint) < 0.1 and fp.likeness(fp.Printed("").fingerprint, fp.Printed("").fingerprint) == 1
    assert fp.likeness(fp.Printed("").fingerprint, x.fingerprint) == 0
    assert abs(fp.likeness(x.fingerprint, fp.Printed(a[: len(a) // 2]).fingerprint) - 0.5) < 0.25
    assert [r[0] for r in spark.createDataFrame([(b,), (None,)], "text string").select(fp.fingerprint("text")).collect()] == [fp.Printed(b).fingerprint, None]
