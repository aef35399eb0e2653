import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations as conv

FORM = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """conversations as lists of (turn, role, text) after damage, in order."""
    out = {}
    told = lambda x: " " if x is None else str(x)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, told(r[2]), told(r[3]))):
        fault = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        here, role, text = out.setdefault(c, []), told(role), told(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        here += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(turns):
    """All edits, by trying letters one after another up to the best cost known."""
    seen, kinds = set(), []
    for _, role, text in turns:
        bare = text.strip(conv.SPACES)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(10**9, "", [])]

    def follow(i, cost, audit, said, inserts):
        letters = "".join(r[:1] for r, _ in said)
        if cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", letters):
            return
        if i == len(turns) and FORM.fullmatch(letters):
            best[0] = min(best[0], (cost, audit, said))
        if inserts < 3:
            for role in ("user", "assistant"):
                follow(i, cost + 5, audit + "I", [*said, (role, "")], inserts + 1)
        if i < len(turns):
            _, role, text = turns[i]
            more = 5 if kinds[i] == "truncated" else 0
            follow(i + 1, cost + 2, audit + "D", said, 0)
            if kinds[i] not in ("blank", "duplicate"):
                if role:
                    follow(i + 1, cost + more, audit + "K", [*said, (role, text)], 0)
                for other in ("user", "assistant"):
                    follow(i + 1, cost + 1 + more, audit + "R", [*said, (other, text)], 0)

    follow(0, 0, "", [], 0)
    cost, audit, said = best[0]
    initials = [r[:1] for _, r, _ in turns]
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def some_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Straße ünd 語?", "Yes.", f"t{t}."])
            rows.append((c if c else None, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows + [rows[0], rows[-1]]


@pytest.mark.parametrize("limit", [conv.LONG_CHARS, 3])
def test_as_by_trying_all_edits(spark, limit):
    rows = some_rows(limit, 60, 6)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).withColumn("edits", F.lit(1)).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conv.repair(frame, conv.damage(), limit).collect()}
    assert got == {c: brute(turns) for c, turns in damaged(rows).items()}


def test_long_conversations_in_one_tensor_with_short_ones(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}!"])) for t in range(3000)] + [(8, 0, "user", "Hi."), (9, 5, "assistant", "a.")]
    got = {r.conv_id: r for r in conv.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), conv.damage()).collect()}
    turns = damaged(rows)[7]
    audit, state, cost, seen = got[7].audit, "", 0, set()
    said, at = [], 0
    for letter in audit:  # the edits give a conversation of the form, at the cost that is told
        want = "assistant" if state[-1:] == "u" else "user"
        role, text = ("", "") if letter == "I" else turns[at][1:]
        bare, twice = text.strip(), (role, text) in seen
        if letter != "I":
            at, seen = at + 1, seen | {(role, text)}
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[letter] + (5 if letter in "KR" and bare[-1] not in ".!?" else 0)
        assert letter not in "KR" or (bare and not twice)
        if letter != "D":
            role = role if letter == "K" else want
            said.append(f"{role}:{text}")
            state += role[0]
    assert FORM.fullmatch(state) and at == len(turns) and cost == got[7].cost
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(said).encode()).hexdigest()
    assert tuple(got[8])[1:] == brute(damaged(rows)[8]) and tuple(got[9])[1:] == brute(damaged(rows)[9])


def test_nothing_left_and_nothing_there(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    form = "conv_id long, turn long, role string, text string"
    got = conv.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], form), conv.damage()).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conv.repair(spark.createDataFrame([], form), conv.damage()).count() == 0
    huge = "word " * 400_000 + "end."
    got = conv.repair(spark.createDataFrame([(1, 0, "user", huge), (1, 1, "assistant", "Ok.")], form)).first()
    assert (got.audit, got.cost, got.repaired_sha256) == ("KK", 0, hashlib.sha256(f"user:{huge}\nassistant:Ok.".encode()).hexdigest())
