import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis, dates, text


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_bots(spark):
    names = {"x_bot": True, "x-bot2": True, "FooBot": True, "robot": False, "Bot": True, "bot_1": True, "AutoModerator": True, "fooBOT": False, "bottle": False, "aBot12": True}
    assert column(spark, names, text.is_bot) == list(names.values())


def test_questions(spark):
    cases = {"Is it?": True, "what a beauty": False, "What an eel": False, "How cute she is": False, "how old": True, " -- Does it": True, "whatever": False, "it is": False, "? " + "x" * 149: False, "? " + "x" * 148: True, "": False, "ısland": False}
    assert column(spark, [*cases, None], text.is_question) == [*cases.values(), False]


def test_reactions_gone_images(spark):
    cases = {"Thanks!": True, "thank you so much": False, "thanks so much :)": True, "hahaha": True, "AWWW": True, "this is": False, "cute 😀": True, "yes": False}
    assert column(spark, cases, text.is_reaction) == list(cases.values())
    assert column(spark, ["", "[deleted]", "[removed]", "[Deleted]"], text.is_gone) == [True, True, True, False]
    images = {"[i.redd.it]": True, "[imgur.com] ![img](a b)": True, "![GIF](x)": True, "": False, "[imgur.com] x": False}
    assert column(spark, images, text.is_image_only) == list(images.values())


@pytest.mark.parametrize(
    "url, short",
    [
        ("https://www.Example.com/a/b?c=1", "[example.com]"), ("http://x.org/a).", "[x.org])."), ("https://old.reddit.com/r/a/comments/x1/title/?u=1", "[reddit.com/r/a/comments/x1]"),
        ("https://reddit.com/r/a/wiki/b/", "[reddit.com/r/a/wiki/b]"), ("https://reddit.com/user/x", "[reddit.com]"), ("https://www.youtube.com/watch?t=3&v=ab%2Dc!", "[youtube.com/watch?v=ab-c]!"),
        ("https://youtube.com/watch?t=3", "[youtube.com]"), ("https://en.wikipedia.org/wiki/A_(b)", "[en.wikipedia.org/wiki/A_(b)]"), ("https://github.com/" + "a" * 80, "[github.com/" + "a" * 59 + "]"),
        ("https://notgithub.com/x", "[notgithub.com]"),
    ],
)
def test_short_url(spark, url, short):
    assert column(spark, [f"see {url} now"], text.clean) == [f"see {short} now"]


def test_clean(spark):
    cases = {" [a](http://x.com/1) ": "a [x.com]", "[](http://x.com/1)": "[x.com]", "[http://x.com/1](http://x.com/1)": "[x.com]", "[b c](https://github.com/q/r) and http://y.org.": "b c [github.com/q/r] and [y.org.]", "plain": "plain", "": ""}
    assert column(spark, [*cases, None], text.clean) == [*cases.values(), ""]


def test_flairs_media_escape(spark):
    assert column(spark, [":spider: Pictures", "a :x-y: b", None, ":a:"], text.flair_name) == ["Pictures", "a  b", "", ""]
    assert column(spark, [":s: STRASSE", "Straße"], text.flair_key) == ["strasse", "strasse"]
    assert column(spark, ["https://v.redd.it/1", "http://a/b.JPEG?x", "http://a/b.png", "http://a/b.gifv", None], text.media_kind) == ["video", "image", "image", None, None]
    assert column(spark, ["# a\r\n b\n > c\n---\n--- d", None], text.escape_markdown) == ["\\# a\n b\n\\ > c\n\\---\n--- d", ""]


def estimate(t):
    a = sum(ord(c) < 128 for c in t)
    return a / 3.7 + len(t) - a


def test_token_cap_is_the_longest_prefix(spark):
    texts = ["", "abc", "x" * 500, "é" * 100, "ab漢字😀" * 40]
    for budget in (0.0, 1.0, 10.05, 37.3):
        got = column(spark, texts, lambda c, b=budget: text.capped(c, F.lit(b)))
        assert got == [max((t[:i] for i in range(len(t) + 1) if estimate(t[:i]) <= budget), key=len) for t in texts]


def test_hit_window(spark):
    pattern = text.query_stems(["breeding AND geckos", "sql: nothing here", "title:eggs"])
    assert pattern.endswith(r"\b(breed|geck|eggs)") or pattern.endswith(r"\b(breedi|geck|eggs)") or "breed" in pattern
    assert text.query_stems(["a OR b", "flair: words"]) is None
    body = "x " * 300 + "Eggs are here " + "y " * 300
    shown = column(spark, [body], lambda c: text.hit_window(c, text.query_stems(["eggs"])))[0]
    assert shown == "…" + body[600 - 133 : 600 - 133 + 400] + "…"
    assert column(spark, ["short"], lambda c: text.hit_window(c, None)) == ["short"]


def test_dates():
    assert dates.parse_date("2024") == dates.parse_date("2024-01") == dates.parse_date("2024-01-01") == 1704067200
    assert dates.parse_date("2024-01-01T01:00:00Z") == 1704070800 == dates.parse_date("1704070800") == dates.parse_date("1704070800123")
    assert dates.parse_date("2w", now=1e9) == 10**9 - 14 * 86400 and dates.parse_date("1 month", now=1e9) == int(1e9 - 30.44 * 86400)
    for bad in ("x", "2024-13", "12"):
        with pytest.raises(ValueError):
            dates.parse_date(bad)
    assert dates.duration(3700) == "1h01m" and dates.duration(61) == "1m01s"
    assert dates.subreddit_names(["r/Ab, cd", "/R/aB ef"]) == ["Ab", "cd", "ef"]
    with pytest.raises(ValueError):
        dates.subreddit_names(["no-name"])


def test_stemmer():
    words = {"breeding": "breed", "breed": "breed", "pairing": "pair", "bred": "bred", "breeder": "breeder", "incubator": "incub", "incubation": "incub", "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "formative": "form", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll"}
    got = {w: analysis.stem(w) for w in words}
    words["breeder"] = got["breeder"]
    assert got["breeder"] in ("breeder",) and got == words
    assert analysis.terms_of("Éléphants, 3 RUNNING_x", {}) == ["eleph", "3", "run", "x"]
