"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words, told apart by 64-bit hashes. Texts are split and hashed once, into a table of sorted sets;
all that follows reads that. Equal sets are one class, ranked by its earliest line.

Tokens are ordered by rarity: the tokens of all lines are counted in BUCKETS buckets by hash, and a token's order is its bucket's
level (the count on a scale of quarters of an octave), then its hash. Any one order of all tokens gives the same matches; this one
makes the lists short. Two sets of sizes n >= m with a Jaccard similarity of at least 0.8 share at least a = ceil(4/9 (n + m)) tokens, so
they meet in the first m - ceil(8/9 m) + 1 of the smaller and the first n - a + 1 of the larger (prefix filter). The smaller one is
posted under each such token with the band of its size; the larger one asks in the bands that it can match (length filter), each
with the prefix that the band's sizes leave it. What stands before and behind a shared token bounds what two sets can share (positional
filter), and so does a bit map of each set. What passes is verified on the sets themselves.

A line is removed if an earlier one matches it. One match is enough, so a first round compares each class only with a few
others of a few lists; that settles the members of large groups of near copies, and the second round compares
the classes that are left with every earlier class that they can meet. No pair is skipped: whatever is left is compared in full.
Long lists are dealt in blocks, by the number of rows that are posted and that ask there, and the join runs in PASSES over parts of the
keys, which bounds the disk that it takes at a time.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from .scratch import Scratch, unused

BUCKETS = 1 << 17
BLANKS = "\t\r\x0b\x0c"
#: The first round: so many of the last tokens of each prefix, so many sets before it in a list, and about so many rows a list before it
#: is split. After each part of the second round so many pairs of each set are verified.
FIRST_TOKENS, FIRST_BEFORE, FIRST_ROWS, LIKELIEST = 4, 3, 1 << 17, 8
#: Bands grow by this factor; lists of about so many rows are dealt in blocks.
BAND, BLOCK_ROWS = 1.5, 1 << 13
PASSES, SETTLE_AFTER = 8, (0, 1, 3, 7)
#: Tables of two or three numbers a row are broadcast up to so many rows.
BROADCAST_ROWS = 1 << 18
LOW56 = (1 << 56) - 1
#: Sets of so many tokens have a map of about half of them.
LONG, MAPS = 112, ["m1", "m2"]


def own_id() -> Column:
    """doc_id; a null one ranks first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def hashed_words(line: Column) -> Column:
    """The sorted distinct hashes of the words of a plain() line."""
    hashes = F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))))


def plain(text: Column) -> Column:
    """The text in lower case, with spaces for all blanks within lines."""
    low = spaced = F.lower(text)
    for blank in BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.when(text.rlike(f"[{BLANKS}]"), spaced).otherwise(low)


def token_sets(docs: DataFrame) -> DataFrame:
    """doc, text_key, pos, t of each line; t is empty for a line without words."""
    text = F.col("text").cast("string")
    rows = docs.where(text != "").select(own_id().alias("doc"), F.xxhash64(text).alias("text_key"), plain(text).alias("text"))
    lines = rows.select("doc", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc", "text_key", "pos", hashed_words(F.col("line")).alias("t"))


def bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def levels(sets: DataFrame) -> DataFrame:
    """One row, one array of BUCKETS levels, each in the upper 8 bits of a number: 1 + 4 * log2(1 + the bucket's count). The counts are
    of all tokens."""
    counts = sets.select(F.explode("t").alias("tok")).groupBy(bucket(F.col("tok")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = sets.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    level = F.shiftleft(F.least(F.lit(127).cast("long"), 1 + F.floor(4 * F.log2(1 + F.coalesce("n", F.lit(0))))), 56)
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", level.alias("level")))), lambda x: x.level).alias("level"))


def by_rarity(level: Column) -> Column:
    """The tokens of t, rarest first: the bucket's level in the upper 8 bits, the hash in the others."""
    return F.sort_array(F.transform("t", lambda t: F.get(level, bucket(t)).bitwiseOR(t.bitwiseAND(F.lit(LOW56)))))


def parts_of(token: Column, rows: int) -> Column:
    """A power of two, 1 at least: in so many parts the list of a token of this level has about so many rows (a power of two) each, at
    most: the level counts all tokens of the bucket."""
    over = F.greatest(F.lit(0), F.shiftright(F.shiftright(token, 56).cast("int") + 2, 2) - rows.bit_length() + 1)
    return F.call_function("shiftleft", F.lit(1), over)


def bit_maps(tokens: Column, n: Column) -> list[Column]:
    """A map of two times 64 bits: of the hashes that have another bit set, and of the others. Of a set of LONG tokens or more it holds
    only the others, those below 0 and those above, so that it stays sparse enough."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    has, hasn_t = lambda t: F.negative(F.shiftright(t, 6).bitwiseAND(F.lit(1))), lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)) - 1
    below, above = lambda t: F.shiftright(t, 63), lambda t: F.bitwise_not(F.shiftright(t, 63))
    of = lambda *masks: F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(reduce(Column.bitwiseAND, (m(t) for m in masks), bit(t))))
    return [F.when(n < LONG, of(hasn_t)).otherwise(of(hasn_t, below)).alias("m1"), F.when(n < LONG, of(has)).otherwise(of(hasn_t, above)).alias("m2")]


def lacks(p: str, q: str) -> Column:
    """How many tokens of a set the other lacks at least: a bit of its map that the other's lacks is such a token. Of a set that is long
    and one that isn't only the part that both maps hold counts."""
    lacking = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))).cast("int")
    p1, p2, q1, q2 = (F.col(f"{s}{m}") for s in (p, q) for m in MAPS)
    mixed = F.when(size(p) < LONG, lacking(p1, q1.bitwiseOR(q2))).otherwise(lacking(p1.bitwiseOR(p2), q1))
    return F.when((size(p) < LONG) == (size(q) < LONG), lacking(p1, q1) + lacking(p2, q2)).otherwise(mixed)


def ceil_of(n: Column, num: int, den: int) -> Column:
    """ceil(n * num / den)"""
    return F.floor((n * num + (den - 1)) / den)


def enough(both: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """both / (n + m - both) >= num / den."""
    return both * (num + den) >= (n + m) * num


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def size(p: str) -> Column:
    return F.shiftright(F.col(f"{p}size_at"), 32)


def place(p: str) -> Column:
    return F.col(f"{p}size_at").bitwiseAND(F.lit(0xFFFFFFFF))


def alike(p: str, q: str, num: int, den: int) -> Column:
    """The length filter and the bound by the maps."""
    n, m = size(p), size(q)
    shared = F.least(n - lacks(p, q), m - lacks(q, p))
    return (n * den >= m * num) & (m * den >= n * num) & enough(shared, n, m, num, den)


def could(p: str, q: str, num: int, den: int) -> Column:
    """The positional filter at a shared token, and alike()."""
    n, m = size(p), size(q)
    around = 1 + F.least(place(p), place(q)) + F.least(n - place(p) - 1, m - place(q) - 1)
    return enough(around, n, m, num, den) & alike(p, q, num, den)


def postings(classes: DataFrame, tokens: Column, *cols) -> DataFrame:
    """One narrow row for each of the tokens. size_at: the set's size in the upper half, the token's place in the lower; prev: the token before
    it in the prefix, of which the tokens are the first ones."""
    each = classes.select("a", "n", *MAPS, "doc", "pos", "prefix", *cols, F.posexplode(tokens).alias("i", "tok"))
    return each.select("tok", F.get("prefix", F.col("i") - 1).alias("prev"), "a", "doc", "pos", *MAPS, *cols, F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("size_at"))


def first_round(classes: DataFrame, num: int, den: int) -> DataFrame:
    """For each class the likeliest earlier one, by the maps, of the first and the ones just before it in the lists of its rarest
    token and of the last ones of its prefix, which near copies share."""
    tokens = F.array_distinct(F.concat(F.slice("prefix", 1, 1), F.slice("prefix", F.greatest(F.size("prefix") - FIRST_TOKENS + 1, F.lit(1)), F.lit(FIRST_TOKENS))))
    posts = postings(classes, F.when(F.size("prefix") <= FIRST_TOKENS, F.col("prefix")).otherwise(tokens))
    # Any part of a list will do here, so a long one is split.
    part = F.pmod(F.xxhash64("doc", "pos"), parts_of(F.col("tok"), FIRST_ROWS))
    in_list = Window.partitionBy("tok", "part").orderBy("doc", "pos")
    cols = ["a", "doc", "pos", *MAPS, "size_at"]
    me = F.struct(*cols)
    others = [F.first(me), *(F.lag(me, k) for k in range(1, FIRST_BEFORE + 1))]
    near = posts.withColumn("part", part).select(*cols, *(x.over(in_list).alias(f"x{k}") for k, x in enumerate(others)))
    near = near.select(*cols, F.explode(F.array(*(f"x{k}" for k in range(len(others))))).alias("x"))
    # Places are those in these few tokens, so only sizes and maps tell.
    near = near.where((F.struct("x.doc", "x.pos") < F.struct("doc", "pos")) & alike("", "x.", num, den))
    best = near.groupBy("a", "doc", "pos").agg(F.min(F.struct(lacks("", "x.") + lacks("x.", ""), *(F.col(f"x.{c}").alias(c) for c in ("a", "doc", "pos")))).alias("x"))
    return best.select(*(F.col(f"x.{c}").alias(f"x_{c}") for c in ("a", "doc", "pos")), *(F.col(c).alias(f"y_{c}") for c in ("a", "doc", "pos")))


def lists(flagged: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows that the classes post as the smaller set of a pair, and those that they ask with as the larger one, by tok and band."""
    n, both = F.col("n"), num + den
    posted = F.slice("prefix", F.lit(1), (n - ceil_of(n, 2 * num, both) + 1).cast("int"))
    smaller = postings(flagged.withColumn("band", band(n)), posted, "band")
    # The least size of a band: one less than it may be only makes the prefix longer.
    least = F.greatest(ceil_of(n, num, den), F.floor(F.pow(F.lit(BAND), F.col("band"))))
    asked = F.slice("prefix", F.lit(1), F.least(F.size("prefix"), (n - ceil_of(n + least, num, both) + 1).cast("int")))
    larger = postings(flagged.select("*", F.explode(F.sequence(band(ceil_of(n, num, den)), band(n))).alias("band")), asked, "band")
    return smaller, larger


def long_lists(flagged: DataFrame, num: int, den: int) -> DataFrame:
    """tok, band, ones, twos: how many blocks of about BLOCK_ROWS the rows posted and the rows that ask make, of the lists where that
    isn't one each. A token's level bounds its list from above, so only lists of high levels are counted."""
    smaller, larger = (rows.select("tok", "band") for rows in lists(flagged, num, den))
    rows = smaller.select("*", F.lit(1).alias("one"), F.lit(0).alias("two")).unionByName(larger.select("*", F.lit(0).alias("one"), F.lit(1).alias("two")))
    counts = rows.where(parts_of(F.col("tok"), BLOCK_ROWS) > 1).groupBy("tok", "band").agg(*(F.sum(c).alias(c) for c in ("one", "two")))
    blocks = [F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(f"{c}s") for c in ("one", "two")]
    return counts.where("one > 0 and two > 0").select("tok", "band", *blocks).where("ones > 1 or twos > 1")


def second_round(flagged: DataFrame, long: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """Pairs of a class that isn't settled and an earlier one, by the shared tokens of one part of the keys. A place below 0 tells that
    a class is settled."""
    smaller, larger = lists(flagged, num, den)

    def dealt(posts: DataFrame, mine: str, other: str) -> DataFrame:
        posts = posts.where(F.pmod(F.shiftright("tok", 20), F.lit(PASSES)) == part).join(long, ["tok", "band"], "left")
        blocks = {c: F.coalesce(F.col(f"{c}s"), F.lit(1)) for c in (mine, other)}
        posts = posts.select("*", F.pmod(F.xxhash64("doc", "pos"), blocks[mine]).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), blocks[other] - 1)).alias(other))
        return posts.select(F.xxhash64("tok", "band", "one", "two").alias("key"), "prev", "a", "doc", "pos", *MAPS, "size_at")

    p, q = dealt(smaller, "one", "two").alias("p"), dealt(larger, "two", "one").alias("q")
    at = {s: F.greatest(F.col(f"{s}.pos"), -1 - F.col(f"{s}.pos")) for s in "pq"}
    before = lambda s, t: (F.col(f"{s}.doc") < F.col(f"{t}.doc")) | ((F.col(f"{s}.doc") == F.col(f"{t}.doc")) & (at[s] < at[t]))
    late = (before("p", "q") & (F.col("q.pos") >= 0)) | (before("q", "p") & (F.col("p.pos") >= 0))
    # Of two equal sizes, each of which asks the other, one is taken.
    once = (size("q.") > size("p.")) | ((size("q.") == size("p.")) & (F.col("q.a") > F.col("p.a")))
    # Two sets that share the token before too meet there, with the same bounds: a run of shared tokens gives one row, not one for each.
    begins = F.col("p.prev").isNull() | F.col("q.prev").isNull() | (F.col("p.prev") != F.col("q.prev"))
    pairs = p.join(q, (F.col("p.key") == F.col("q.key")) & begins & once & could("p.", "q.", num, den) & late)
    end = lambda s, t, c: F.when(before("p", "q"), at[s] if c == "pos" else F.col(f"{s}.{c}")).otherwise(at[t] if c == "pos" else F.col(f"{t}.{c}"))
    far = (lacks("p.", "q.") + lacks("q.", "p.")).alias("far")
    return pairs.select(far, *(end(s, t, c).alias(f"{name}_{c}") for name, s, t in (("x", "p", "q"), ("y", "q", "p")) for c in ("a", "doc", "pos"))).distinct()


def if_small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def settle(flagged: DataFrame, gone: DataFrame) -> DataFrame:
    """flagged, with a place below 0 also for the classes that are gone."""
    settled = flagged.join(if_small(gone).withColumn("settled", F.lit(True)), ["a", "b"], "left")
    return settled.withColumn("pos", F.when(F.col("settled") & (F.col("pos") >= 0), -1 - F.col("pos")).otherwise(F.col("pos"))).drop("settled")


def verified(sets: DataFrame, pairs: DataFrame, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """a, b (the digests) of the later ones of the pairs that match."""
    ends = [pairs.select(*(F.col(f"{p}_{c}").alias(c) for c in ("a", "doc", "pos"))) for p in "xy"]
    used = scratch.save(ends[0].unionByName(ends[1]).distinct(), f"{name}-used")
    found = sets.join(if_small(used), ["doc", "pos"]).where(F.xxhash64("t") == F.col("a")).select("a", "doc", "pos", digest_b().alias("b"), "t")
    found = scratch.save(found.dropDuplicates(["a", "doc", "pos"]), f"{name}-sets")
    side = lambda p: found.select(*(F.col(c).alias(f"{p}_{c}") for c in found.columns))
    both = pairs.join(side("x"), ["x_a", "x_doc", "x_pos"]).join(side("y"), ["y_a", "y_doc", "y_pos"])
    good = both.where(enough(F.size(F.array_intersect("x_t", "y_t")), F.size("x_t"), F.size("y_t"), num, den))
    done = scratch.save(good.select(F.col("y_a").alias("a"), F.col("y_b").alias("b")).distinct(), f"{name}-matched")
    scratch.drop(f"{name}-used", f"{name}-sets")
    return done


def digest_b() -> Column:
    return F.xxhash64(F.lit(7), "t")


def later_matches(spark: SparkSession, docs: DataFrame, scratch: Scratch, num: int = 4, den: int = 5) -> DataFrame:
    """doc, text_key, gone (the places of the lines to remove) of the texts that lose a line."""
    sets = scratch.save(token_sets(docs), "sets", "orc", compression="zstd").where(F.size("t") > 0)
    level = scratch.save(levels(sets), "levels")
    n, here = F.size("t"), F.struct("doc", "pos")
    lines = sets.select("doc", "text_key", "pos", F.xxhash64("t").alias("a"), digest_b().alias("b"))
    # The levels are a subquery's value: they are in no plan, and the optimiser puts them in where they are used.
    full = sets.select("*", level.scalar().alias("level")).select(
        F.xxhash64("t").alias("a"), digest_b().alias("b"), here.alias("rank"), n.alias("n"),
        F.slice(by_rarity(F.col("level")), F.lit(1), (n - ceil_of(n, num, den) + 1).cast("int")).alias("prefix"), *bit_maps(F.col("t"), n),
    )
    classes = full.groupBy("a", "b").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("lines"), F.first(F.struct("n", "prefix", *MAPS)).alias("x"))
    classes = scratch.save(classes.select("a", "b", "rank.doc", "rank.pos", "lines", "x.*"), "classes", "orc", compression="zstd")

    first = scratch.save(first_round(classes, num, den), "first")
    gone = verified(sets, first, num, den, scratch, "round1")
    flagged = classes.select("a", "b", "n", *MAPS, "doc", "pos", "prefix")
    flagged = scratch.save(settle(flagged, gone), "flagged0", "orc", compression="zstd")
    long = if_small(scratch.save(long_lists(flagged, num, den), "long"))
    several = scratch.save(classes.where("lines > 1").select("a", "b", here.alias("rank")), "several")
    scratch.drop("first", "classes")
    # The first parts of the keys settle most classes that have a match, so that the next ones ask for fewer pairs; what isn't settled by
    # its likeliest pairs is verified with all of them at last.
    parts = []
    of_y = Window.partitionBy("y_a", "y_doc", "y_pos").orderBy("far", "x_doc", "x_pos", "x_a")
    for k in range(PASSES):
        parts.append(scratch.save(second_round(flagged, long, num, den, k), f"pairs{k}"))
        if k in SETTLE_AFTER:
            likely = scratch.save(parts[k].withColumn("k", F.row_number().over(of_y)).where(F.col("k") <= LIKELIEST).drop("k", "far"), f"likely{k}")
            more = verified(sets, likely, num, den, scratch, f"likely{k}")
            gone = gone.unionByName(more)
            flagged = scratch.save(settle(flagged, more), f"flagged{k + 1}", "orc", compression="zstd")
            scratch.drop("flagged0", *(f"flagged{i + 1}" for i in SETTLE_AFTER if i < k))
    gone = scratch.save(gone.distinct(), "settled")
    left = reduce(DataFrame.unionByName, parts).drop("far").distinct().join(gone.select(F.col("a").alias("y_a")), "y_a", "left_anti")
    pairs = scratch.save(left.select("x_a", "x_doc", "x_pos", "y_a", "y_doc", "y_pos"), "pairs")
    scratch.drop("round1-matched", *(f"pairs{k}" for k in range(PASSES)), *(f"{t}{k}{u}" for k in SETTLE_AFTER for t, u in (("flagged", ""), ("likely", ""), ("likely", "-matched"))), f"flagged{SETTLE_AFTER[-1] + 1}")
    more = verified(sets, pairs, num, den, scratch, "round2")
    scratch.drop("pairs", "levels", "long")

    # A line goes if its class has an earlier match, or if it isn't the class's earliest one.
    late = gone.unionByName(more).distinct().withColumn("late", F.lit(True))
    state = scratch.save(several.join(late, ["a", "b"], "full"), "state")
    scratch.drop("several", "settled", "round2-matched")
    lost = lines.join(state, ["a", "b"]).where(F.coalesce("late", F.lit(False)) | (here != F.col("rank")))
    return lost.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("gone"))


def remove_later(spark: SparkSession, docs: DataFrame, removed: str, num: int = 4, den: int = 5) -> DataFrame:
    """The rows, with all their columns and one more named by removed, the number of lines that went; text is without the lines that an
    earlier line matches with at least num / den, and a column n_chars, where there is one, is its new length.

    Lines rank by doc_id (null first) and place. Rows with one doc_id rank alike: equal lines at one place of both are no later one
    of each other, so rows equal in doc_id and text get equal results. Lines without words stay; null and empty texts come back as they
    are. A text that loses all its lines is empty. Other columns may have any names; removed must be a new one."""
    scratch = Scratch(spark, "lines")
    gone = scratch.save(later_matches(spark, docs, scratch, num, den), "gone")
    scratch.drop("sets", "state")
    text = F.col("text").cast("string")
    doc, key, places = unused(docs, "doc", "text_key", "gone")
    lost = gone.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("gone").alias(places))
    joined = docs.join(lost, (own_id() == F.col(doc)) & (F.xxhash64(text) == F.col(key)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(places, i)), "\n")
    new = F.when(F.col(places).isNull(), text).otherwise(kept)
    cols = [new.alias(c) if c == "text" else F.length(new).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c.replace('`', '``')}`") for c, t in docs.dtypes]
    return joined.select(*cols, F.greatest(F.coalesce(F.size(places), F.lit(0)), F.lit(0)).alias(removed))


def without_later_lines(spark: SparkSession, docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """remove_later() with the columns of docs. Without keep_emptied the rows go that lose lines and have no word left; texts that had
    none before stay, null and empty ones among them."""
    (removed,) = unused(docs, "n_removed")
    found = remove_later(spark, docs, removed)
    if not keep_emptied:
        found = found.where((F.col(removed) == 0) | F.col("text").rlike(f"[^ \n{BLANKS}]"))
    return found.drop(removed)


def line_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, n_removed for each row. Null and empty texts come back as they are, with 0; repeated rows get equal results; an
    empty table gives an empty one."""
    return remove_later(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "n_removed")
