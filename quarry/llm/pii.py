"""Surrogates for personal data and secrets, in DataFrame functions only.

Entities are found by patterns; each has a type and a canonical form (an email in lower case, the digits of a phone or card number,
a name without its title), so all mentions of one entity in all documents get one surrogate, written in the format of the mention.
A surrogate is drawn from a keyed hash: digits for digits, letters of the same script and case for letters, names for names by the
gender of the title and the script. All entities are then checked against each other: a surrogate that two share, or that is
itself an entity of that type, is drawn anew for all but one, until none is left.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

DEFAULT_KEY, MAX_DRAWS = "change-this-key", 32

#: The patterns, in the order in which they are tried at a place.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"),
    ("secret", r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"),
    ("card", r"(?<!\d)(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?!\d)"),
    ("name", r"(?<=\bMr\.? |\bMrs\.? |\bMs\.? |\bMiss |\bHerr |\bFrau |\bMonsieur |\bMadame |\bSeñor |\bSeñora |\bг-н |\bг-жа )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text without these holds no entity; most texts are passed over by this alone.
QUICK = r"@|\d|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|г-н|г-жа)\b"
FEMALE_TITLE = r"(?:\b(?:Mrs|Ms)\.?|\b(?:Miss|Frau|Madame|Señora|г-жа)) $"
#: Names by script and gender, and last names by script.
NAMES = {
    ("latin", "f"): "Alma Beth Clara Dora Edith Fiona Greta Helen Irene Julia Karen Laura Maria Nora Olga Paula Rita Sarah Tessa Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Erik Frank Georg Henry Ivan Jonas Kevin Louis Martin Noel Oscar Peter Ralph Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София Тамара".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан".split(),
}
LAST = {
    "latin": "Abbott Barlow Carver Dalton Ellison Fenwick Garner Hollis Ingram Jarvis Keller Lawson Merton Norwood Osborn Prescott Quimby Rowland Sheldon Thornton Underhill Vernon Whitby Yardley".split(),
    "cyrillic": "Авдеенко Бойко Гончаренко Довженко Ермоленко Зинченко Кириенко Лысенко Макаренко Науменко Онищенко Павленко Романенко Савченко Ткаченко".split(),
}
#: Letters by script and case; a character outside of all stays.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def kind_of(mention: Column, before: Column) -> Column:
    """The type of a mention: the first pattern that it fits as a whole; a name's is told by the title before it."""
    kind = F.when(mention.rlike(r"^\p{Lu}\p{Ll}") & ~mention.rlike(r"[@\d]"), F.when(before.rlike(FEMALE_TITLE), "name f").otherwise("name m"))
    for name, pattern in PATTERNS[:-1]:
        kind = kind.when(mention.rlike(f"^(?:{pattern})$"), name)
    return kind.otherwise("phone")


def canonical(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn", "phone"), digits).otherwise(mention)


def noise(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """Hex digits of a keyed hash."""
    seeds = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string"), F.lit(str(i))), 256) for i in range(4)]
    return F.concat(*seeds)


def byte_at(hexes: Column, i: Column) -> Column:
    """A number below 65536 for a place; places repeat after 64."""
    return F.conv(F.substring(hexes, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def redraw(text: Column, hexes: Column, hexadecimal: bool = False) -> Column:
    """The text with each character of an alphabet replaced by one of the same alphabet."""

    def one(c, i):
        out = c
        for letters in ["0123456789abcdef"] if hexadecimal else ALPHABETS:
            new = F.substring(F.lit(letters), F.pmod(byte_at(hexes, i), F.lit(len(letters))) + 1, F.lit(1))
            out = F.when(F.instr(F.lit(letters), c) > 0, new).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))) + 1)


def surrogate(key: str) -> Column:
    """The surrogate's canonical form, from the columns kind, canon and draw."""
    kind, canon, draw = F.col("kind"), F.col("canon"), F.col("draw")
    h = noise(key, kind, canon, draw)
    octets = F.concat_ws(".", *((F.pmod(byte_at(h, F.lit(i)), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)))
    # An email keeps the shape of its local part; what identifies its domain goes, its top-level domain stays.
    local, host = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    extra = F.when(draw >= 2, F.substring(h, F.lit(200), draw)).otherwise("")
    email = F.concat(redraw(local, h), extra, F.lit("@"), redraw(F.substring_index(host, ".", 1), F.reverse(h)), F.lit(".example."), F.substring_index(host, ".", -1))
    # Of a phone number the country code stays, of the rest the first digit isn't 0.
    keep = F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).otherwise(F.lit(0))
    number = F.concat(F.substring(canon, F.lit(1), keep), (F.pmod(byte_at(h, F.lit(60)), F.lit(9)) + 1).cast("string"), redraw(F.substring(canon, keep + 2, F.length(canon)), h))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F.lit(None).cast("string")
    lasts = lambda words: F.array_join(F.transform(F.sequence(F.lit(0), F.least(draw, F.lit(20))), lambda i: pick(words, byte_at(h, i + 2))), "-")
    for s in LAST:
        for g in "fm":
            first, last = pick(NAMES[s, g], byte_at(h, F.lit(1))), lasts(LAST[s])
            full = F.when(F.instr(canon, " ") > 0, F.concat_ws(" ", first, last)).otherwise(last)
            name = F.when((script == s) & (kind == f"name {g}"), full).otherwise(name)
    secret = F.when(canon.rlike("^[0-9a-f]+$"), redraw(canon, h, True)).otherwise(
        F.concat(F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-|)", 1), redraw(F.regexp_replace(canon, "^(?:AKIA|gh[pousr]_|sk-)", ""), h)))
    return F.when(kind == "email", email).when(kind == "ip", octets).when(kind.startswith("name"), name).when(kind == "secret", secret).otherwise(number)


def in_format(kind: Column, mention: Column, canon: Column) -> Column:
    """A surrogate's canonical form in the format of a mention: its digits between the mention's other characters; an email all
    in capitals as such."""
    place = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"\D", ""))
    filled = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(canon, place(i), F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("card", "ssn", "phone"), filled).when((kind == "email") & (mention == F.upper(mention)), F.upper(canon)).otherwise(canon)


def draw_all(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, new for each entity; new is distinct within a kind (both genders of names together) and is no entity."""
    group = F.regexp_replace("kind", " .*", "").alias("group")
    state = scratch.save(entities.withColumn("draw", F.lit(0)).withColumn("new", surrogate(key)), "draw-0")
    for step in range(1, MAX_DRAWS):
        taken = state.groupBy(group, "new").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kind", "canon")).alias("owner")).where("n > 1")
        real = state.select(group, F.col("canon").alias("new")).distinct().withColumn("real", F.lit(True))
        twice = state.select("kind", "canon", "draw", "new", group).join(taken, ["group", "new"], "left").join(real, ["group", "new"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.col("n").isNotNull() & (F.struct("kind", "canon") != F.col("owner")))
        marked = scratch.save(twice.select("kind", "canon", "draw", "new", again.alias("again")), f"marked-{step}")
        if not marked.where("again").limit(1).count():
            return marked.select("kind", "canon", "new")
        kept = marked.where("not again").select("kind", "canon", "draw", "new")
        state = scratch.save(kept.unionByName(marked.where("again").select("kind", "canon", (F.col("draw") + 1).alias("draw")).withColumn("new", surrogate(key)).select("kind", "canon", "draw", "new")), f"draw-{step}")
    raise ValueError(f"surrogates still collide after {MAX_DRAWS} draws")


def pseudonymise(spark: SparkSession, docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, text (with surrogates), n_entities for each row.

    Null and empty texts and texts without an entity come back as they are, with 0 entities. Repeated rows get equal results. The
    same key gives the same surrogates, as long as the entities in the table are the same."""
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    maybe = F.coalesce(F.col("text").rlike(QUICK), F.lit(False))
    found = rows.where(maybe).distinct().select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions")).where(F.size("mentions") > 0)
    found = found.withColumn("between", F.split("text", ANY, -1))
    each = found.select("doc_id", "text_key", F.posexplode(F.arrays_zip("mentions", F.slice(F.col("between"), F.lit(1), F.size("mentions")).alias("before"))).alias("pos", "x"))
    before = F.substring(F.col("x.before"), F.greatest(F.length("x.before") - 11, F.lit(1)), F.lit(12))
    each = each.select("doc_id", "text_key", "pos", F.col("x.mentions").alias("mention"), kind_of(F.col("x.mentions"), before).alias("kind"))
    each = scratch.save(each.withColumn("canon", canonical(F.col("kind"), F.col("mention"))), "mentions")
    new = draw_all(each.select("kind", "canon").distinct(), scratch, key)
    # One entity may have most of the mentions: both sides are written tables, so Spark can split its join.
    filled = each.join(new, ["kind", "canon"]).select("doc_id", "text_key", "pos", in_format(F.col("kind"), F.col("mention"), F.col("new")).alias("new"))
    filled = filled.groupBy("doc_id", "text_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x.new).alias("new"))
    filled = scratch.save(filled, "filled")

    has = rows.where(maybe).withColumn("text_key", F.xxhash64("text"))
    on = has["doc_id"].eqNullSafe(filled["doc_id"]) & (has["text_key"] == filled["text_key"])
    joined = has.join(filled, on, "left").select(has["doc_id"], "text", "new")
    zipped = F.zip_with(F.split("text", ANY, -1), F.concat(F.col("new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    done = joined.select("doc_id", F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(zipped, "")).alias("text"), F.coalesce(F.size("new"), F.lit(0)).alias("n_entities"))
    done = done.withColumn("n_entities", F.greatest("n_entities", F.lit(0)))
    return done.unionByName(rows.where(~maybe).withColumn("n_entities", F.lit(0)))
