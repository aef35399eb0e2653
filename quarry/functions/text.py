"""Text functions over columns. All stay in the JVM: what needs a callback in a plain regex library is done by splitting a text at
its matches, changing the matches as an array, and joining the two again."""

from pyspark.sql import Column, functions as F

# What counts as gone, as a bot, as a reaction, as a question and as an image.
GONE = ["", "[deleted]", "[removed]"]
BOT_NAMES = ["automoderator", "sneakpeekbot", "remindmebot", "savevideo", "stabbot", "haikusbot"]
REACTIONS = ["thanks?( (you|so much))?", "thank you", "ty", "tysm", "lol", "lmao", r"haha\w*", "omg", "aww+", "so cute", "cute", "same", "this", "agreed?", "nice", "wow", "love (it|him|her|this)", "beautiful", "gorgeous", "adorable"]
QUESTION_WORDS = "how what when where why who which is are can should does do will has have".split()
EXCLAMATIONS = ["what an?", "how (cute|cool|nice|pretty|beautiful|adorable|awesome|lovely|gorgeous)"]
IMAGE_HOSTS = ["i.redd.it", "preview.redd.it", "i.imgur.com", "imgur.com", "giphy.com", "media.giphy.com", "tenor.com"]
PATH_HOSTS = ["github.com", "huggingface.co", "doi.org", "wikipedia.org", "arxiv.org", "youtube.com", "youtu.be"]
URL = r"(?U)https?://(?:www\.)?([^/\s()\[\]<>]+)((?:[^\s()\[\]<>]|\([^\s()]*\))*)"
LINK_TARGET = r"https?://(?:[^\s()]|\([^\s()]*\))*"
URL_PATH_CHARS, QUESTION_TAIL, WINDOW_CHARS = 60, 150, 400
CHARS_PER_TOKEN = 3.7


def any_of(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def literal(words: list[str]) -> str:
    return any_of([w.replace(".", r"\.") for w in words])


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def is_gone(c: Column) -> Column:
    return c.isin(GONE)


def is_bot(name: Column) -> Column:
    return F.lower(name).isin(BOT_NAMES) | name.rlike(r"(?i)[_-]bot[_-]?\d*$") | name.rlike(r"[a-z0-9]Bot\d*$") | name.rlike(r"(?i)^bot[_-]?\d*$")


def is_reaction(c: Column) -> Column:
    return c.rlike(rf"(?iuU)^\W*{any_of(REACTIONS)}\W*$")


def is_question(c: Column) -> Column:
    """A question mark near the end, or a question word first that doesn't start an exclamation. Null is no question."""
    t = strip(F.coalesce(c, F.lit("")))
    starts = t.rlike(rf"(?iuU)^\W*{any_of(QUESTION_WORDS)}\b") & ~t.rlike(rf"(?iuU)^\W*{any_of(EXCLAMATIONS)}\b")
    return F.contains(F.right(t, F.lit(QUESTION_TAIL)), F.lit("?")) | starts


def is_image_only(c: Column) -> Column:
    return c.rlike(rf"(?iuU)^\s*((\[{literal(IMAGE_HOSTS)}\]|!\[(img|gif)\]\([^)]*\))\s*)+$")


def short_url(url: Column) -> Column:
    """A URL as [host], with a short path where the path names something; punctuation at its end stays behind it."""
    host, rest = F.lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)
    body = F.regexp_replace(rest, r"""[.,;:!?'"]+\z""", "")
    tail = F.substring(rest, F.length(body) + 1, F.length(rest))
    whole = F.substring_index(body, "?", 1)
    path = F.regexp_replace(whole, r"/+\z", "")
    query = F.substring(body, F.length(whole) + 2, F.length(body))
    thread = F.regexp_extract(path, r"(?U)^/r/\w+/comments/\w+", 0)
    video = F.try_url_decode(F.regexp_extract(query, "(?:^|&)v=([^&]+)", 1))
    at = lambda h: host.rlike(rf"(^|\.){h}$")
    forum = at(r"reddit\.com")
    shown = (
        F.when(forum, F.when(thread != "", thread).when(path.startswith("/r/"), path).otherwise(""))
        .when(at(r"youtube\.com") & (path == "/watch"), F.when(video != "", F.concat(F.lit("/watch?v="), video)).otherwise(""))
        .when(at(literal(PATH_HOSTS)), path).otherwise("")
    )
    return F.concat(F.lit("["), F.when(forum, "reddit.com").otherwise(host), F.substring(shown, 1, URL_PATH_CHARS), F.lit("]"), tail)


def replace_matches(c: Column, pattern: str, change) -> Column:
    """The text with each match of a pattern changed by a function of columns."""
    found = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), change), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda a, b: F.concat(a, b)), "")


def clean(c: Column) -> Column:
    """Trimmed, links as their text and target, URLs shortened. Null is empty."""
    t = strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, rf"(?U)\[\s*\]\(({LINK_TARGET})\)", "$1")
    t = F.regexp_replace(t, rf"(?U)\[\s*({LINK_TARGET})\s*\]\(\1\)", "$1")
    t = F.regexp_replace(t, rf"(?U)\[([^\]]*)\]\(({LINK_TARGET})\)", "$1 $2")
    return F.when(F.contains(t, F.lit("://")), replace_matches(t, URL, short_url)).otherwise(t)


def flair_name(flair: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(flair, F.lit("")), r"(?U):[\w-]+:", ""))


def flair_key(flair: Column) -> Column:
    """Compares flairs without case; the sharp s is spelled out, as full case folding does."""
    return F.replace(F.lower(flair_name(flair)), F.lit("ß"), F.lit("ss"))


def media_kind(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    image = u.rlike(r"(?i)i\.redd\.it|reddit\.com/gallery|imgur\.com|\.(jpe?g|png|gif|webp)(\?|$)")
    return F.when(F.contains(u, F.lit("v.redd.it")), "video").when(image, "image")


def permalink(sub: Column, post_id: Column) -> Column:
    return F.concat(F.lit("https://www.reddit.com/r/"), sub, F.lit("/comments/"), post_id, F.lit("/"))


def escape_markdown(c: Column) -> Column:
    """Lines that would be a heading, a quote or a rule get a backslash in front."""
    lines = F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"(?U)^\s*(#|>|---\s*$)"), F.concat(F.lit("\\"), x)).otherwise(x)), "\n")


def estimated_tokens(c: Column) -> Column:
    ascii_chars = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return ascii_chars / F.lit(CHARS_PER_TOKEN) + (F.length(c) - ascii_chars)


def capped(c: Column, tokens: Column) -> Column:
    """The longest prefix within so many estimated tokens: the estimate grows with each character, so bisection finds it. No character counts
    less than an ASCII one, so what can't fit is cut off first."""
    c = F.substring(c, F.lit(1), F.least(F.ceil(F.greatest(tokens, F.lit(0.0)) * CHARS_PER_TOKEN) + 1, F.lit(2**31 - 1)).cast("int"))
    fits = lambda n: estimated_tokens(F.substring(c, F.lit(1), n)) <= tokens
    span = F.struct(F.lit(0).alias("lo"), F.length(c).alias("hi"))

    def halve(s, _):
        mid = F.floor((s.lo + s.hi + 1) / 2).cast("int")
        ok = fits(mid)
        return F.struct(F.when(s.lo >= s.hi, s.lo).when(ok, mid).otherwise(s.lo).alias("lo"), F.when(s.lo >= s.hi, s.hi).when(ok, s.hi).otherwise(mid - 1).alias("hi"))

    n = F.aggregate(F.sequence(F.lit(1), F.lit(31)), span, halve, lambda s: s.lo)
    return F.when(estimated_tokens(c) <= tokens, c).otherwise(F.substring(c, F.lit(1), n))


def query_stems(queries: list[str]) -> str | None:
    """A pattern for where a text matches queries: the stems of their plain words at the start of a word, longer ones first."""
    import re

    words = set()
    for q in queries:
        if not q.startswith(("sql: ", "flair: ")):
            plain = re.sub(r"\b(?:AND|OR|NOT|NEAR)\b|\b\w+:", " ", q)
            words.update(w.lower() for w in re.findall(r"[^\W\d_]{3,}", plain))
    stems = sorted({w[: max(min(4, len(w)), len(w) - 3)] for w in words}, key=lambda s: (-len(s), s))
    return rf"(?iuU)\b({'|'.join(stems)})" if stems else None


def hit_window(body: Column, pattern: str | None, size: int = WINDOW_CHARS) -> Column:
    """The text around the first match; cut sides are marked."""
    at = F.regexp_instr(body, F.lit(pattern)) if pattern else F.lit(0)
    start = F.greatest(at - 1 - size // 3, F.lit(0))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(body, start + 1, F.lit(size)), F.when(start + size < F.length(body), "…").otherwise(""))


def repair_surrogates(value):
    """A decoded JSON value with lone surrogates as U+FFFD; for readers that decode in Python."""
    return "".join("�" if 0xD800 <= ord(ch) <= 0xDFFF else ch for ch in value) if isinstance(value, str) else value
