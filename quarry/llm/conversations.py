"""Repair of conversations whose turns are damaged: the cheapest edits that make the roles alternate, by a tensor DP over time.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn; only the first letter of
a role counts, and a turn with an empty role can't be kept as it is. Edits, with their costs: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and repeated turns have to go), Insert an
empty user or assistant turn anywhere 5; a truncated turn that isn't deleted costs 5 more. Of equally cheap edits the ones whose initials
in order are least in ASCII are taken. The state before each turn is one of four: nothing kept, after a system, a user, an assistant
turn; an initial and a state say what comes next, so that the initials name one way of repair.

Conversations of about equal length form a tensor (turn, conversation, state) of the costs from a turn to the end, filled from the last
turn back for all of them at once and then traced forward for all of them at once.

Rows are dealt by conversation and read in order as a stream. A conversation of up to LONG_CHARS characters is repaired as it comes.
Of a longer one only some 40 bytes a turn are held (digest, kind, costs): its edits are written first, and a second pass over its turns,
which begins with those edits, streams them into the hash. The digest of a conversation covers all its text in order, so that one task
has to read it all; it doesn't hold it.

Nulls: a null role or text, and a null in the key that deals out the damage, stands for one space; rows with a null conv_id form one
conversation; null turns come first. Turns with the same number are taken by role and text as they were. Repeated rows are turns of their
own. An empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Turns that are repaired at a time, and characters of a conversation whose texts are held until then.
TURNS, LONG_CHARS = 65_536, 32 << 20
SPACES = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NEVER = np.int32(1 << 28)
#: The state after a turn of the user or the assistant is added, by state; and after a turn with initial s, u, a or another is kept.
ADDED = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.full((4, 4), -1)
KEPT[0, NOTHING] = SYSTEM
KEPT[1, [NOTHING, SYSTEM, ASSISTANT]] = USER
KEPT[2, USER] = ASSISTANT
#: Initials that may follow each other: su, ua, au.
LEGAL = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]


def told(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage() -> dict[str, Column]:
    """role, text and copies (0: dropped, 1, or 2: repeated) of turns that are damaged by the checksum of their key."""
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return {"role": F.when(fault == 4, F.lit("user")).otherwise(F.col("role")), "text": text, "copies": F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)}


def as_they_are() -> dict[str, Column]:
    return {"role": F.col("role"), "text": F.col("text"), "copies": F.lit(1)}


def step_costs(kind: np.ndarray, must_go: np.ndarray, cut: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """The costs by conversation and state of deleting, keeping and reroling one turn each, up to the end; after: costs behind the turn."""
    more = np.where(cut, 5, 0)[:, None]
    delete = after + 2
    to = KEPT[kind]
    keep = np.where((to >= 0) & ~must_go[:, None], np.take_along_axis(after, np.maximum(to, 0), axis=1) + more, NEVER)
    rerole = np.where(must_go[:, None], NEVER, after[:, ADDED] + 1 + more)
    return delete, keep, rerole


def with_inserts(costs: np.ndarray) -> np.ndarray:
    """The costs if turns may be inserted first; more than two in a row never pay."""
    out = costs.copy()
    out[:, USER] = np.minimum(costs[:, USER], costs[:, ASSISTANT] + 5)
    out[:, ASSISTANT] = np.minimum(costs[:, ASSISTANT], costs[:, USER] + 5)
    for s in (NOTHING, SYSTEM):
        out[:, s] = np.minimum(costs[:, s], out[:, USER] + 5)
    return out


def cheapest(kind: np.ndarray, must_go: np.ndarray, cut: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kind (0 s, 1 u, 2 a, 3 other), must_go and cut by turn and conversation, filled up behind each length. Returns the cost of each
    conversation and its edits' initials as bytes by step and conversation, 0 where there is none."""
    turns, n = kind.shape
    costs = np.full((turns + 1, n, 4), NEVER, np.int32)
    end = np.full((n, 4), NEVER, np.int32)
    end[:, [NOTHING, ASSISTANT]] = 0
    costs[turns] = with_inserts(end)
    for t in range(turns - 1, -1, -1):
        here = with_inserts(np.minimum.reduce(step_costs(kind[t], must_go[t], cut[t], costs[t + 1])))
        costs[t] = np.where((t < length)[:, None], here, costs[t + 1])
    state, rows = np.zeros(n, np.int64), np.arange(n)
    said = np.zeros((3 * (turns + 1), n), np.uint8)
    for t in range(turns + 1):
        left = t < length if t < turns else np.zeros(n, bool)
        open_ = left | (t == length)
        want = costs[t]
        if t < turns:
            ways = step_costs(kind[t], must_go[t], cut[t], costs[t + 1])
        for k in range(3):
            best = want[rows, state]
            if t < turns:
                delete, keep, rerole = (w[rows, state] for w in ways)
                can = [left & (delete == best), open_ & (want[rows, ADDED[state]] + 5 == best), left & (keep == best), left & (rerole == best)]
            else:
                can = [left, open_ & (want[rows, ADDED[state]] + 5 == best), left, left]
            took = np.select(can, [1, 2, 3, 4], 0)
            said[3 * t + k] = np.array([0, *b"DIKR"], np.uint8)[took]
            moved = np.select([took == 2, took == 3, took == 4], [ADDED[state], KEPT[kind[t] if t < turns else 0, state], ADDED[state]], state)
            state = moved
            done = took != 2
            left, open_ = left & ~done, open_ & ~done
    return costs[0, :, NOTHING].astype(np.int64), said


def audits(kind: np.ndarray, must_go: np.ndarray, cut: np.ndarray, bounds: np.ndarray) -> list[tuple[int, bytes]]:
    """Cost and initials of each conversation, of flat arrays over all turns and the bounds of the conversations."""
    length = np.diff(bounds)
    out: list = [None] * len(length)
    bucket = np.ceil(np.log2(np.maximum(length, 1)) * 4).astype(int)  # at most a fifth longer than the shortest one of a bucket
    for b in np.unique(bucket):
        who = np.flatnonzero(bucket == b)
        longest = int(length[who].max())
        at = np.minimum(bounds[who][None, :] + np.arange(longest)[:, None], max(len(kind) - 1, 0))
        cost, said = cheapest(*((x[at] if longest else np.zeros((0, len(who)), x.dtype)) for x in (kind, must_go, cut)), length[who])
        for j, i in enumerate(who):
            column = said[:, j]
            out[i] = int(cost[j]), column[column > 0].tobytes()
    return out


class Digest:
    """The hash of a repaired conversation, fed turn by turn with the edits."""

    def __init__(self, audit: bytes):
        self.sha, self.audit, self.at, self.state, self.first = hashlib.sha256(), audit, 0, NOTHING, True

    def say(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + f"{role}:{text}").encode())
        self.first = False

    def added(self) -> str:
        self.state = int(ADDED[self.state])
        return "user" if self.state == USER else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == b"I":
            self.at += 1
            self.say(self.added(), "")

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at : self.at + 1]
        self.at += 1
        if edit == b"K":
            self.state = int(KEPT["sua".find(role[0]), self.state])
            self.say(role, text)
        elif edit == b"R":
            self.say(self.added(), text)

    def end(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


class Talk:
    """What is held of one conversation while its turns come in, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.kind, self.fault, self.digest, self.texts, self.chars = conv_id, bytearray(), bytearray(), bytearray(), [], 0
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn, role: str, text: str, copies: int, limit: int) -> None:
        if copies and turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        for _ in range(copies):
            bare = text.rstrip(SPACES)
            self.kind.append("sua".find(role[0]) % 4 if role else 3)
            self.fault.append(1 if not bare else 3 if bare[-1] not in ".!?" else 0)
            self.digest += hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            self.chars += len(role) + len(text)
            if self.texts is not None:
                self.texts.append((role, text))
        if self.chars > limit:
            self.texts = None

    def faults(self) -> np.ndarray:
        """1 blank, 2 duplicate, 3 truncated, 0 none, for each turn."""
        fault = np.frombuffer(bytes(self.fault), np.uint8).copy()
        if len(fault):
            seen = np.frombuffer(bytes(self.digest), [("a", "<u8"), ("b", "<u8")])
            later = np.ones(len(fault), bool)
            later[np.unique(seen, return_index=True)[1]] = False
            fault[later & (fault != 1)] = 2
        return fault


def solved(talks: list[Talk]) -> pa.RecordBatch:
    faults = [t.faults() for t in talks]
    kinds = [np.frombuffer(bytes(t.kind), np.uint8) for t in talks]
    bounds = np.r_[0, np.cumsum([len(k) for k in kinds])].astype(np.int64)
    fault, kind = (np.concatenate(x) if x else np.zeros(0, np.uint8) for x in (faults, kinds))
    found = audits(kind.astype(np.int64), (fault == 1) | (fault == 2), fault == 3, bounds)
    out = []
    for t, f, k, (cost, audit) in zip(talks, faults, kinds, found):
        sha = None
        if t.texts is not None:
            d = Digest(audit)
            for role, text in t.texts:
                d.turn(role, text)
            sha = d.end()
        illegal = int((~np.isin(k[:-1] * 4 + k[1:], LEGAL)).sum())
        gaps = t.last - t.first + 1 - t.distinct if t.distinct else 0
        out.append((t.conv_id, gaps, *(int((f == x).sum()) for x in (1, 2, 3)), illegal, cost, audit.decode(), sha))
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names=[x.split()[0] for x in RESULT.split(", ")])


def repair_sorted(limit: int):
    """A function for mapInArrow over turns in order; repaired_sha256 is null for conversations whose texts weren't held."""

    def run(batches):
        talk, ready, turns, chars = None, [], 0, 0
        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if talk is None or conv_id != talk.conv_id:
                    if talk is not None:
                        ready.append(talk)
                        turns, chars = turns + len(talk.kind), chars + (talk.chars if talk.texts else 0)
                    if turns >= TURNS or chars >= limit:
                        yield solved(ready)
                        ready, turns, chars = [], 0, 0
                    talk = Talk(conv_id)
                talk.add(turn, role, text, copies, limit)
        if talk is not None:
            yield solved([*ready, talk])

    return run


def digest_sorted(batches):
    """conv_id and repaired_sha256; the first row of each conversation has its edits as text, copies -1."""
    conv_id = digest = None
    for batch in batches:
        for c, _, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if copies < 0:
                if digest:
                    yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([digest.end()])], ["conv_id", "sha"])
                conv_id, digest = c, Digest(text.encode())
            for _ in range(copies):
                digest.turn(role, text)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([digest.end()])], ["conv_id", "sha"])


def in_order(turns: DataFrame, change: dict[str, Column], edits: DataFrame | None = None) -> DataFrame:
    """Turns of each conversation together and in order, then changed; before them the edits (conv_id, audit), if there are any."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), F.lit(False).alias("edits"))
    if edits is not None:
        rows = rows.unionByName(edits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("edits")))
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("edits"), F.asc_nulls_first("turn"), "role", "text")
    whole = {"role": F.col("role"), "text": F.col("text"), "copies": F.lit(-1)}
    return ordered.select("conv_id", "turn", *(F.when(F.col("edits"), whole[c]).otherwise(change[c]).alias(c) for c in whole))


def repair(turns: DataFrame, change: dict[str, Column] | None = None, limit: int = LONG_CHARS) -> DataFrame:
    """Each conv_id with its faults and the cheapest repair, in the columns of RESULT. turns: conv_id, turn, role, text, ...; change: what
    role, text and copies become before anything is counted."""
    change, scratch = change or as_they_are(), Scratch(turns.sparkSession, "conversations")
    found = scratch.save(in_order(turns, change).mapInArrow(repair_sorted(limit), RESULT), "repairs")
    long_ = found.where("repaired_sha256 is null")
    if long_.isEmpty():
        return found
    ids = long_.select(F.col("conv_id").alias("__long"))
    again = turns.join(ids, F.col("conv_id").eqNullSafe(F.col("__long")), "left_semi")
    sha = in_order(again, change, long_).mapInArrow(digest_sorted, "conv_id long, sha string").select(F.col("conv_id").alias("__id"), "sha")
    sha = scratch.save(sha, "digests")
    whole = found.join(sha, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    return whole.select(*(c for c in found.columns if c != "repaired_sha256"), F.coalesce("repaired_sha256", "sha").alias("repaired_sha256"))
