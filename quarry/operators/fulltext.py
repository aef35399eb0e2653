"""Full-text search over an inverted index that is an ordinary table.

postings(kind, doc, col, term, positions): one row for each term of each column of each document. A query is parsed on the driver
into a tree and compiled into one scan of the postings of its terms (the predicates on term reach Parquet), one grouping by
document and one boolean expression over what was found.

The language: words (AND between them, inside one document), OR, NOT, parentheses, "a phrase", prefix*, NEAR(a b, n) and col:word.
NOT binds tighter than AND, AND tighter than OR. A phrase or NEAR is within one column. NEAR wants all its parts with no more
than n terms between the first and the last of them (10 if n is left out). A query without a term is an error.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.analysis import ANALYSERS, QUERY_ANALYSERS


class BadQuery(ValueError):
    """The query can't be parsed."""


@dataclass
class Leaf:
    """A phrase of one or more terms, or NEAR over several; prefix: the last term is a prefix."""

    phrases: list[list[str]]
    prefix: bool = False
    col: str | None = None
    near: int | None = None


@dataclass
class Node:
    op: str
    kids: list = field(default_factory=list)


TOKEN = re.compile(r'\s*(?:(?P<near>NEAR\s*\()|(?P<quote>"[^"]*")|(?P<punct>[():,])|(?P<word>[^\s():",]+))')


class Parser:
    def __init__(self, text: str, analyser: str):
        self.analyse, self.tokens, at = QUERY_ANALYSERS[analyser], [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise BadQuery(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", ""))

    def peek(self, n: int = 0):
        return self.tokens[min(n, len(self.tokens) - 1)]

    def take(self):
        return self.tokens.pop(0) if len(self.tokens) > 1 else self.tokens[0]

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise BadQuery(f"unexpected {self.peek()[1]!r}")
        return tree

    def chain(self, op: str, part, more):
        kids = [part()]
        while more():
            kids.append(part())
        return kids[0] if len(kids) == 1 else Node(op, kids)

    def word_is(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in words

    def skip(self, word: str) -> bool:
        if self.word_is(word):
            self.take()
            return True
        return False

    def either(self):
        return self.chain("or", self.all_of, lambda: self.skip("OR"))

    def all_of(self):
        more = lambda: self.skip("AND") or (self.peek()[0] in ("near", "quote", "word") and not self.word_is("OR", "NOT", "AND")) or self.peek() == ("punct", "(")
        return self.chain("and", self.without, more)

    def without(self):
        return self.chain("not", self.one, lambda: self.skip("NOT"))

    def one(self):
        kind, value = self.take()
        if (kind, value) == ("punct", "("):
            tree = self.either()
            if self.take() != ("punct", ")"):
                raise BadQuery("a parenthesis isn't closed")
            return tree
        if kind == "word" and self.peek() == ("punct", ":"):
            self.take()
            leaf = self.one()
            if not isinstance(leaf, Leaf):
                raise BadQuery("a column stands before a word or phrase")
            leaf.col = value
            return leaf
        if kind == "near":
            return self.near()
        if kind == "quote" or (kind == "word" and value not in ("AND", "OR", "NOT")):
            return self.leaf(kind, value)
        raise BadQuery(f"unexpected {value!r}" if value else "a term is missing")

    def leaf(self, kind: str, value: str) -> Leaf:
        if kind == "word" and value.endswith("*"):
            parts = re.findall(r"[^\W_]+", value.lower())
            prefix = True
        else:
            parts, prefix = self.analyse(value.strip('"')), False
        if not parts:
            raise BadQuery(f"{value!r} holds no term")
        return Leaf([parts], prefix)

    def near(self) -> Leaf:
        phrases, n = [], 10
        while True:
            kind, value = self.take()
            if (kind, value) == ("punct", ")"):
                break
            if (kind, value) == ("punct", ","):
                number = self.take()[1]
                if not number.isdigit() or self.take() != ("punct", ")"):
                    raise BadQuery("NEAR ends in , number )")
                n = int(number)
                break
            if kind not in ("word", "quote"):
                raise BadQuery("NEAR holds words and phrases")
            phrases += self.leaf(kind, value).phrases
        if not phrases:
            raise BadQuery("NEAR without terms")
        return Leaf(phrases, near=n)


def parse(query: str, analyser: str = "plain"):
    return Parser(query, analyser).parse()


def leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for kid in tree.kids for x in leaves(kid)]


def runs(pairs: Column) -> Column:
    """An array of term and positions, each term once, of one of term and pos. What is used more than once is bound to the variable of a
    lambda, so it is computed once."""

    def cut(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when(~x.term.eqNullSafe(F.get(s, i - 1).term), i)), lambda i: i.isNotNull())
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).term.alias("term"), positions(F.slice(s, at + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - at)).alias("positions"))))[0]

    return F.transform(F.array(F.sort_array(pairs)), cut)[0]


def positions(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: x.pos)


def placed(terms: Column, wanted=None) -> Column:
    at = lambda w, i: F.struct(w.alias("term"), i.alias("pos"))
    terms = F.coalesce(terms, F.expr("cast(array() as array<string>)"))
    return F.transform(terms, at) if wanted is None else F.filter(F.transform(terms, lambda w, i: F.when(wanted(w), at(w, i))), lambda x: x.isNotNull())


def build_postings(docs: DataFrame, kind: str, doc: str, cols: list[str], analyser: str = "plain", wanted=None) -> DataFrame:
    """kind, doc, col, term, positions for the columns of a table. Rows without a term have none. To store it, sort by term within
    partitions: then a term's row groups are found by their bounds.

    A document's terms are sorted and cut where they stand: the texts are shuffled once, by document, as several rows may be of one, and no
    token is. wanted: a condition on a term; other terms get no postings, and go before anything is shuffled or sorted."""
    dealt = docs.select(F.col(doc).alias("doc"), *(F.col(c).alias(f"__c{n}") for n, c in enumerate(cols)))
    before, after = (lambda t: t, placed) if wanted is None else (lambda t: placed(t, wanted), lambda t: t)
    dealt = dealt.repartition("doc") if wanted is None else dealt
    terms = dealt.select("doc", F.struct(*(before(ANALYSERS[analyser](F.col(f"__c{n}"))).alias(f"t{n}") for n in range(len(cols)))).alias("__row"))
    rows = terms.groupBy("doc").agg(F.collect_list("__row").alias("__rows"))
    of = lambda n: F.flatten(F.transform("__rows", lambda r: after(r[f"t{n}"])))
    found = F.flatten(F.array(*(F.transform(runs(of(n)), lambda x: F.struct(F.lit(c).alias("col"), x.term.alias("term"), x.positions.alias("positions"))) for n, c in enumerate(cols))))
    return rows.select("doc", F.explode(found).alias("__p")).select(F.lit(kind).alias("kind"), "doc", "__p.*")


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings in ranges of term and document, each sorted: a term is found by the bounds of row groups, and a very common one is spread
    over as many files as it fills."""
    postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").partitionBy("kind").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc string, col string, term string, positions array<int>, kind string").parquet(path)


def term_is(leaf: Leaf, phrase: list[str], i: int, term: Column | None = None) -> Column:
    last, term = leaf.prefix and i == len(phrase) - 1, F.col("term") if term is None else term
    return term.startswith(phrase[i]) if last else term == phrase[i]


def wanted_by(trees: list):
    """Is a term one that a leaf of parsed queries looks for?"""
    each = [(leaf, phrase, i) for tree in trees for leaf in leaves(tree) for phrase in leaf.phrases for i in range(len(phrase))]

    def wanted(term: Column) -> Column:
        out = F.lit(False)
        for leaf, phrase, i in each:
            out = out | term_is(leaf, phrase, i, term)
        return out

    return wanted


def phrase_starts(leaf: Leaf, phrase: list[str], col: str) -> Column:
    """The positions in a column at which the phrase starts; an aggregate."""
    starts = None
    for i in range(len(phrase)):
        at = F.flatten(F.collect_list(F.when((F.col("col") == col) & term_is(leaf, phrase, i), F.col("positions"))))
        here = shifted(at, i) if i else at
        starts = here if starts is None else F.array_intersect(starts, here)
    return starts


def shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def close(starts: list[Column], lengths: list[int], n: int) -> Column:
    """Has each phrase a start with no more than n terms between the first and the last phrase? Each start of any phrase is tried
    as the leftmost; the others need a start in the window that it opens."""
    out = F.lit(False)
    for i, first in enumerate(starts):
        rest = [(other, n + sum(lengths) - lengths[j]) for j, other in enumerate(starts) if j != i]
        out = out | F.exists(first, opens(rest))
    return out


def opens(rest: list[tuple[Column, int]]):
    def all_fit(p: Column) -> Column:
        ok = F.lit(True)
        for other, width in rest:
            ok = ok & F.exists(other, within(p, width))
        return ok

    return all_fit


def within(p: Column, width: int):
    return lambda q: (q > p) & (q - p <= width)


def flag(leaf: Leaf, cols: list[str]) -> Column:
    """Does a document hold a leaf? An aggregate over its postings."""
    on = [leaf.col] if leaf.col else cols
    if len(leaf.phrases) == 1 and len(leaf.phrases[0]) == 1:
        return F.max(F.col("col").isin(on) & term_is(leaf, leaf.phrases[0], 0))
    out = None
    for c in on:
        starts = [phrase_starts(leaf, p, c) for p in leaf.phrases]
        here = F.size(starts[0]) > 0 if len(starts) == 1 else close(starts, [len(p) for p in leaf.phrases], leaf.near)
        out = here if out is None else out | here
    return out


def search_all(postings: DataFrame, kind: str, cols: list[str], queries: dict[str, str], analyser: str = "plain") -> DataFrame:
    """doc, query for the documents of a kind that match each of several named queries: one scan of the postings of all their terms, one
    grouping. A column that the kind lacks is an error, as a query that can't be parsed is."""
    trees = {name: parse(q, analyser) for name, q in queries.items()}
    flags, found = {}, []
    for leaf in (x for tree in trees.values() for x in leaves(tree)):
        if leaf.col is not None and leaf.col not in cols:
            raise BadQuery(f"no such column: {leaf.col}")
        flags[id(leaf)] = f"leaf{len(flags)}"
        found.append(flag(leaf, cols).alias(flags[id(leaf)]))

    def truth(node) -> Column:
        if isinstance(node, Leaf):
            return F.col(flags[id(node)])
        kids = [truth(x) for x in node.kids]
        out = kids[0]
        for x in kids[1:]:
            out = out | x if node.op == "or" else out & x if node.op == "and" else out & ~x
        return out

    docs = postings.where((F.col("kind") == kind) & wanted_by(list(trees.values()))(F.col("term"))).groupBy("doc").agg(*found)
    names = F.filter(F.array(*(F.when(truth(tree), F.lit(name)) for name, tree in trees.items())), lambda x: x.isNotNull())
    return docs.select("doc", F.explode(names).alias("query"))


def search(postings: DataFrame, kind: str, cols: list[str], query: str, analyser: str = "plain") -> DataFrame:
    """doc of the documents of a kind that match one query."""
    return search_all(postings, kind, cols, {"": query}, analyser).select("doc")


def search_texts(docs: DataFrame, kind: str, doc: str, cols: list[str], queries: dict[str, str], analyser: str = "plain") -> DataFrame:
    """search_all() over a table without stored postings: only those of terms that the queries name are made."""
    wanted = wanted_by([parse(q, analyser) for q in queries.values()])
    return search_all(build_postings(docs, kind, doc, cols, analyser, wanted), kind, cols, queries, analyser)


def two_sided(postings: DataFrame, comments: DataFrame, query: str, analyser: str = "plain") -> tuple[DataFrame, DataFrame]:
    """The posts and the comments (id, post_id) that match. A column that only one side has leaves the other side empty; if
    neither side can run the query is bad."""
    sides, errors = {}, {}
    for kind, cols in (("post", ["title", "selftext"]), ("comment", ["body"])):
        try:
            sides[kind] = search(postings, kind, cols, query, analyser)
        except BadQuery as e:
            errors[kind] = e
            if "no such column" not in str(e):
                raise
    if len(errors) == 2:
        raise errors["post"]
    empty = postings.select("doc").limit(0)
    posts = sides.get("post", empty).withColumnRenamed("doc", "id")
    hits = comments.select("id", "post_id").join(sides.get("comment", empty).withColumnRenamed("doc", "id"), "id", "left_semi")
    return posts, hits


def zero_hit_hints(vocabulary: DataFrame, query: str, examples: int = 3) -> DataFrame:
    """word, prefix, terms for each prefix* of a query that no term starts with: the longest shorter prefix, cut by up to four
    letters down to four, that some do, with the first such terms; null where there is none. vocabulary: term."""
    spark = vocabulary.sparkSession
    words = [w.lower() for w in re.findall(r"(\w+)\*", query)]
    rows = [(w, w[:n], n == len(w)) for w in dict.fromkeys(words) for n in range(len(w), max(3, len(w) - 5), -1)] or [("", "", True)]
    tries = spark.createDataFrame(rows, "word string, prefix string, whole boolean").where("word <> ''")
    shortest = [w[: max(1, min(4, len(w)))] for w in words]
    near = F.lit(False)
    for s in shortest:
        near = near | F.col("term").startswith(s)
    terms = vocabulary.where(near).select("term").distinct()
    # The words of a query are few; their prefixes are joined by equality on the prefix of each term.
    lengths = sorted({len(p) for _, p, _ in rows})
    cut = terms.select("term", F.explode(F.array(*(F.substring("term", 1, n) for n in lengths))).alias("prefix")).where(F.length("term") >= F.length("prefix")).distinct()
    found = tries.join(cut, "prefix", "left").groupBy("word", "prefix", "whole").agg(F.slice(F.array_sort(F.collect_set("term")), 1, examples).alias("terms"))
    best = found.groupBy("word").agg(F.max(F.when(F.size("terms") > 0, F.struct(F.length("prefix").alias("n"), "prefix", "terms", "whole"))).alias("best"))
    return best.where("best is null or not best.whole").select("word", "best.prefix", "best.terms")
