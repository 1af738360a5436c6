"""Surrogates for personal data: every detected entity gets a replacement of its
own kind, decided by a secret key.

Digits are replaced through a keyed permutation of all digit strings of their
length (a Feistel network over the two halves), so different numbers of one kind
and format never meet. Letters are replaced from a keyed hash: words of a name or
of a mail address become syllables in the script and the letter case they came in,
first names of a gender one of that gender. Equal entities get equal surrogates in
all documents, so references stay intact. Names are found after titles; in the same
document they are also replaced where they, or words of them, come without one.
Whether two different entities got the
same surrogate, or one that is itself in the corpus, is checked over all distinct
entities, and those that did are keyed again until none is left.

Everything is built-in functions of Spark: texts are cut at the entities, the
pieces are put together again in place, and no text is shuffled. Only distinct
entities are, as hashed pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.llm.tables import store, text_of

# What stands before a secret and before a name.
SECRET_BEFORE = r"""(?i:password|passwd|pwd|token|secret|api_key|apikey)(?: ?[=:] ?)["']?"""
TITLE_BEFORE = r"\b(?iu:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? "
# The patterns of the entities, first match in this order.
PATTERNS = {
    # A local part starts where its run of letters does and is taken whole, so a long
    # run is read once. Names have 127 labels at most; the engine recurses on each.
    "mail": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){1,126}",
    "key": r"AKIA[0-9A-Z]{16}",
    # The first look behind is quick and fails nearly everywhere.
    "secret": rf"(?<=[=: \"'])(?<={SECRET_BEFORE})[0-9A-Za-z+/_\-]{{8,}}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)",
    "card": r"(?<!\d)(?:\d{16}|\d{4}(?<sep>[ \-])\d{4}\k<sep>\d{4}\k<sep>\d{4}|3[47]\d{13})(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"(?<![\d\p{L}])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?!\d)|\+\d{8,15}(?!\d)",
    "name": rf"(?=\p{{Lu}})(?<= )(?<={TITLE_BEFORE})\p{{Lu}}\p{{L}}+(?:[ \-]\p{{Lu}}\p{{L}}+){{0,2}}",
}
# Titles by gender, and syllables of the surrogates by script.
FEMALE = r"(?iu:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\.? $"
MALE = r"(?iu:Mr|Herr|Monsieur|Señor|Sr)\.? $"
FEMALE_NAMES = "Anna Clara Elena Emma Ida Julia Laura Lena Maria Nora Paula Rosa Sara Sofia Vera Zoe".split()
MALE_NAMES = "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Martin Oscar Paul Simon Tomas Viktor".split()
ANY_NAMES = "Alex Andrea Charlie Dominique Eli Jamie Jo Kim Lee Lou Max Morgan Noa Robin Sam Sascha".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta te to".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та те то".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λι λο μα με μι μο να νε νο ρα ρε ρι ρο σα σε τα τε το".split(),
}

#: All of them; a text without a match of HINT has no match of this.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[0-9@=:]|AKIA|\b(?iu:[DFHMS])(?iu:r|rs|s|iss|err|rau|onsieur|adame|me|eñor|eñora|ra)\.? "

ROUNDS = 4
#: Corrections kept in a map that goes to all tasks; more are joined instead.
MAPPED_ROWS = 20_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def _hash(key: str, *parts: Column) -> Column:
    """Keyed hash as hex: the key is hashed in on both sides of the parts."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _number(hex_digits: Column, start: int = 1, digits: int = 12) -> Column:
    """A part of a hash as a number."""
    return F.conv(F.substring(hex_digits, start, digits), 16, 10).cast("long")


def _permuted_half(key: str, kind: Column, half: Column, other: Column, round_no: int, attempt: Column) -> Column:
    """One half moved by a keyed number of the other, within its own length."""
    size = F.length(half)
    modulus = F.rpad(F.lit("1"), size + 1, F.lit("0")).cast("long")
    h = _hash(key, F.lit(str(round_no)), kind, attempt, size.cast("string"), other)
    moved = F.pmod(F.when(half == "", F.lit(0)).otherwise(half.cast("long")) + _number(h), modulus)
    return F.when(half == "", half).otherwise(F.lpad(moved.cast("string"), size, F.lit("0")))


def permuted_digits(key: str, kind: Column, digits: Column, attempt: Column) -> Column:
    """A keyed permutation of the digit strings of each length (up to 30)."""

    def step(n: int):
        def swap(state: Column) -> Column:
            left, right = state.getItem(0), state.getItem(1)
            return F.array(right, _permuted_half(key, kind, left, right, n, attempt))

        return swap

    def halves(d: Column) -> Column:
        cut = F.floor(F.length(d) / 2).cast("int")
        return F.array(F.substring(d, F.lit(1), cut), F.substring(d, cut + 1, F.length(d)))

    state = _let(digits, halves)
    for n in range(ROUNDS):
        state = _let(state, step(n))
    return _let(state, lambda s: F.concat(s.getItem(0), s.getItem(1)))


def _refilled(shape: Column, digits: Column) -> Column:
    """The text of ``shape`` with its digits replaced, in turn, by ``digits``."""

    def fill(new: Column) -> Column:
        filled = F.aggregate(
            F.split(shape, r"(?<=\d)|(?=\d)"),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, p: F.when(
                p.rlike(r"^\d$"),
                F.struct(F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
            ).otherwise(F.struct(F.concat(s["out"], p).alias("out"), s["at"].alias("at"))),
        )
        return filled["out"]

    return _let(digits, fill)


def _luhn_digit(digits: Column) -> Column:
    """Check digit that makes the digits before it and itself a valid card number."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a
        + F.when(
            F.pmod(n - i, F.lit(2)) == 0,
            F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, F.substr(digits, i, F.lit(1)).cast("int") * 2 - 9).otherwise(
                F.substr(digits, i, F.lit(1)).cast("int") * 2
            ),
        ).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return F.pmod(-total, F.lit(10)).cast("string")


def _is_luhn(digits: Column) -> Column:
    n = F.length(digits)
    return F.substring(digits, n, F.lit(1)) == _luhn_digit(F.substring(digits, F.lit(1), n - 1))


def _pick(items: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), F.pmod(number, F.lit(len(items))).cast("int"))


def _script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _syllables(hashed: Column, script: Column, count: int, start: int = 1) -> Column:
    def of(name: str) -> Column:
        return F.concat(*[_pick(SYLLABLES[name], _number(hashed, start + 4 * i, 4)) for i in range(count)])

    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _characters(hashed: Column, text: Column) -> Column:
    """Letters and digits replaced one by one, keeping case and hexadecimal digits."""
    more = F.concat(hashed, F.sha2(hashed, 256), F.sha2(F.reverse(hashed), 256), F.sha2(F.concat(hashed, hashed), 256))
    kinds = F.when(text.rlike("^[0-9a-f]+$"), "x").otherwise("")

    def replaced(told: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = F.conv(F.substr(told["stream"], F.pmod(i * 2, F.lit(254)) + 1, F.lit(2)), 16, 10).cast("int")
            at = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
            return (
                F.when(told["kinds"] == "x", at("0123456789abcdef"))
                .when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike("[a-z]"), at("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[0-9]"), at("0123456789"))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return _let(F.struct(more.alias("stream"), kinds.alias("kinds")), replaced)


def kind_of(before: Column, entity: Column) -> Column:
    """The kind of a detected entity: what stands before it decides for secrets
    and names, else the first pattern that fits the whole of it."""
    branches = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k not in ("secret", "name")]):
        branches = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(branches)
    return F.when(before.rlike(SECRET_BEFORE + "$"), "secret").when(before.rlike(TITLE_BEFORE + "$"), "name").otherwise(branches)


def surrogate(key: str, entity: Column, kind: Column, gender: Column, attempt: Column) -> Column:
    """The replacement of one entity; another one for each ``attempt``."""
    tries = attempt.cast("string")
    return _let(_hash(key, kind, tries, entity), lambda h: _surrogate(key, entity, kind, gender, tries, h))


def _card(key: str, entity: Column, digits: Column, tries: Column) -> Column:
    """A card keeps its issuer's first digit and, if it had one, a valid check digit."""
    head, body = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2)
    own = F.substring(digits, F.length(digits), F.lit(1)).cast("int")

    def with_last(inner: Column) -> Column:
        moved = F.pmod(own + _number(_hash(key, F.lit("last"), tries, inner)), F.lit(10)).cast("string")
        return F.concat(inner, F.when(_is_luhn(digits), _luhn_digit(inner)).otherwise(moved))

    inner = F.concat(head, permuted_digits(key, F.concat(F.lit("card"), head), body, tries))
    return _refilled(entity, _let(inner, with_last))


def _surrogate(key: str, entity: Column, kind: Column, gender: Column, tries: Column, hashed: Column) -> Column:
    script = _script_of(entity)
    digits = F.regexp_replace(entity, r"\D", "")
    permuted = permuted_digits(key, F.concat(kind, F.regexp_replace(entity, r"\d", "0")), digits, tries)
    card = _let(digits, lambda d: _card(key, entity, d, tries))

    # Country code and area stay: they are format, not identity.
    country = F.regexp_extract(entity, r"^(\+\d{1,3})(?=[ .\-(])", 1)
    rest = F.substr(entity, F.length(country) + 1)
    own = permuted_digits(
        key, F.concat(F.lit("phone"), country, F.regexp_replace(rest, r"\d", "0")), F.regexp_replace(rest, r"\D", ""), tries
    )
    phone = F.concat(country, _refilled(rest, own))

    # Addresses of a network: each of the four numbers below 256, first one public.
    ip = F.concat_ws(
        ".",
        F.concat(F.pmod(_number(hashed, 1, 6), F.lit(110)) + 12).cast("string"),
        *[F.pmod(_number(hashed, 1 + 8 * i, 6), F.lit(254 if i == 3 else 256)).cast("string") for i in (1, 2, 3)],
    )

    local = F.regexp_extract(entity, "^([^@]+)@", 1)
    host = F.regexp_extract(entity, "@(.+)$", 1)
    mail = F.concat(
        _syllables(hashed, script, 4),
        F.when(local.contains("."), F.lit(".")).otherwise(F.lit("")),
        F.pmod(_number(hashed, 20, 8), F.lit(10_000)).cast("string"),
        F.lit("@"),
        _syllables(_hash(key, F.lit("host"), tries, F.lower(host)), F.lit("latin"), 3),
        F.lit(".example."),
        F.regexp_extract(host, r"([^.]+)$", 1),
    )

    # First names and family names have surrogates of their own, so that a family
    # name alone still refers to the same person.
    words = F.split(entity, r"[ \-]")
    given = _hash(key, F.lit("given"), tries, F.lower(F.get(words, F.lit(0))))
    chosen = _number(given, 1, 8)
    first = (
        F.when((script == "latin") & (gender == "f"), _pick(FEMALE_NAMES, chosen))
        .when((script == "latin") & (gender == "m"), _pick(MALE_NAMES, chosen))
        .when(script == "latin", _pick(ANY_NAMES, chosen))
        .otherwise(F.initcap(_syllables(given, script, 2)))
    )
    family = F.initcap(_syllables(_hash(key, F.lit("family"), tries, F.lower(F.element_at(words, -1))), script, 4))
    middle = F.initcap(_syllables(given, script, 2, 41))
    name = (
        F.when(F.size(words) == 1, family)
        .when(F.size(words) == 2, F.concat(first, F.regexp_extract(entity, r"([ \-])", 1), family))
        .otherwise(F.concat_ws(" ", first, middle, family))
    )
    name = F.when(entity == F.upper(entity), F.upper(name)).otherwise(name)

    return (
        F.when(kind == "mail", mail)
        .when(kind == "key", F.concat(F.lit("AKIA"), _characters(hashed, F.substring(entity, 5, 16))))
        .when(kind == "secret", _characters(hashed, entity))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), _characters(hashed, F.substr(entity, F.lit(3)))))
        .when(kind == "ssn", _refilled(entity, permuted))
        .when(kind == "phone", phone)
        .when(kind == "name", name)
        .otherwise(entity)
    )


def mark_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_gaps``, the text between the entities, and ``_found``, an array of
    ``(entity, kind, gender)``. Texts without an entity have one gap."""
    whole = text_of(text)
    may = whole.rlike(HINT)
    cut = docs.withColumn("_gaps", F.when(may, F.split(whole, ANY, -1)).otherwise(F.array(whole)))
    entities = F.when(F.size("_gaps") > 1, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def told(entity: Column, i: Column) -> Column:
        before = F.get(F.col("_gaps"), i)
        gender = F.when(before.rlike(FEMALE), "f").when(before.rlike(MALE), "m")
        return F.struct(entity.alias("entity"), kind_of(before, entity).alias("kind"), gender.alias("gender"))

    return cut.withColumn("_found", F.transform(entities, told))


def _occurrences(marked: DataFrame, *columns: Column) -> DataFrame:
    """One row for each entity ``f``. An inner explode would add a filter on the
    size of the array, below which all texts are cut a second time."""
    return marked.select(*columns, F.explode_outer("_found").alias("f")).filter("f IS NOT NULL")


def surrogate_table(marked: DataFrame, key: str) -> DataFrame:
    """``entity, kind, gender, attempt, surrogate, mixed`` of all distinct entities.

    No two rows have the same surrogate and none is itself an entity of the
    corpus. ``gender`` is that of all occurrences that show one, null if they
    disagree; ``mixed`` if not every occurrence shows it.
    """
    each = _occurrences(marked).select("f.*")
    known = each.groupBy("entity", "kind").agg(
        F.min("gender").alias("low"), F.max("gender").alias("high"), F.max(F.col("gender").isNull()).alias("bare")
    )
    gender = F.when(F.col("low") == F.col("high"), F.col("low"))
    table = known.select(
        "entity",
        "kind",
        gender.alias("gender"),
        (F.col("low").isNotNull() & (F.col("bare") | gender.isNull())).alias("mixed"),
        F.lit(0).alias("attempt"),
    )
    made = surrogate(key, F.col("entity"), F.col("kind"), F.col("gender"), F.col("attempt"))
    table = store(table.withColumn("surrogate", made), "surrogates")
    while True:
        owner = table.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("owner"))
        real = table.select(F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        checked = table.join(owner, "surrogate").join(real, "surrogate", "left").withColumn(
            "clash", (F.struct("kind", "entity") != F.col("owner")) | F.col("real").isNotNull()
        )
        checked = store(checked.drop("owner", "real"), "checked")
        if checked.filter("clash").isEmpty():
            return checked.drop("clash")
        again = checked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        table = store(
            again.withColumn("surrogate", F.when(F.col("clash"), made).otherwise(F.col("surrogate"))).drop("clash"),
            "surrogates",
        )


def _name_parts(entity: Column, new: Column) -> Column:
    """``(w, s)``: a name and each of its words, in every letter case, and what stands for it."""
    words = F.zip_with(F.split(entity, r"[ \-]"), F.split(new, r"[ \-]"), lambda w, s: F.struct(w.alias("w"), s.alias("s")))
    pairs = F.concat(F.array(F.struct(entity.alias("w"), new.alias("s"))), words)
    same = lambda x: x
    return F.flatten(
        F.transform(pairs, lambda p: F.array(*[F.struct(f(p["w"]).alias("w"), f(p["s"]).alias("s")) for f in (same, F.upper, F.initcap)]))
    )


def _renamed(gap: Column, parts: Column, pattern: Column) -> Column:
    """``(text, n)``: a gap with the names replaced that recur in it, and how many."""

    def put(hits: Column) -> Column:
        new = F.transform(hits, lambda x: F.filter(parts, lambda p: p["w"] == x).getItem(0)["s"])
        pieces = F.zip_with(F.split(gap, pattern, -1), F.concat(new, F.array(F.lit(""))), lambda g, s: F.concat(g, s))
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(hits).alias("n"))

    return _let(F.regexp_extract_all(gap, pattern, F.lit(0)), put)


def with_recurrences(gaps: Column, found: Column, replaced: Column) -> Column:
    """The gaps, ``(text, n)`` each, with the names among ``found`` replaced where
    they, or one of their words, recur without a title."""
    names = F.filter(
        F.zip_with(found, replaced, lambda f, s: F.struct(f["entity"].alias("w"), f["kind"].alias("kind"), s.alias("s"))),
        lambda n: n["kind"] == "name",
    )
    # Longer ones first, so that a whole name goes before its words.
    parts = F.array_sort(
        F.array_distinct(F.flatten(F.transform(names, lambda n: _name_parts(n["w"], n["s"])))),
        lambda a, b: F.length(b["w"]) - F.length(a["w"]),
    )

    def rename(told: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(told, lambda p: p["w"]), "|"), F.lit(r")(?!\p{L})"))
        return _let(F.struct(told.alias("parts"), pattern.alias("pattern")), lambda t: F.transform(gaps, lambda g: _renamed(g, t["parts"], t["pattern"])))

    bare = F.transform(gaps, lambda g: F.struct(g.alias("text"), F.lit(0).alias("n")))
    return F.when(F.exists(found, lambda f: f["kind"] == "name"), _let(parts, rename)).otherwise(bare)


def replace_private(docs: DataFrame, key: str, text: str = "text", counted: str | None = "n_replaced") -> DataFrame:
    """Replace all personal data in ``text``; add their number as ``counted``.

    A null text stays null and an empty one empty; all other columns stay as they
    are, rows stay one to one, and equal texts give equal results. A column named
    as ``counted`` is replaced; without a name nothing is added.
    """
    marked = mark_entities(docs, text)
    table = surrogate_table(marked, key)
    # What the expression gives by itself needs no table; the rest is looked up.
    fixes = table.filter("attempt > 0 OR mixed").select("entity", "kind", "surrogate")
    same = [F.xxhash64(text).alias("_h1"), F.xxhash64(F.col(text), F.lit(1)).alias("_h2")]
    maps = (
        _occurrences(marked, *same)
        .select("_h1", "_h2", "f.entity", "f.kind").distinct()
        .join(fixes, ["entity", "kind"])
        .groupBy("_h1", "_h2")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "entity"), "surrogate"))).alias("_fixes"))
    )
    if fixes.isEmpty():
        ready = marked.withColumn("_fixes", F.lit(None).cast("map<string,string>"))
    else:
        maps = store(maps, "fixes")
        few = maps.count() <= MAPPED_ROWS
        ready = marked.select("*", *same).join(F.broadcast(maps) if few else maps, ["_h1", "_h2"], "left")
    replaced = F.transform(
        "_found",
        lambda f: F.coalesce(
            F.try_element_at(F.col("_fixes"), F.concat_ws("|", f["kind"], f["entity"])),
            surrogate(key, f["entity"], f["kind"], f["gender"], F.lit(0)),
        ),
    )

    def told(new: Column) -> Column:
        gaps = with_recurrences(F.col("_gaps"), F.col("_found"), new)
        return _let(
            gaps,
            lambda gaps: F.struct(
                F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, s: F.concat(g["text"], s)), "").alias("text"),
                F.aggregate(gaps, F.size(new), lambda n, g: n + g["n"]).alias("n"),
            ),
        )

    done = ready.withColumn("_done", F.when(F.size("_found") > 0, _let(replaced, told)))
    done = done.withColumn(text, F.when(F.col("_done").isNotNull(), F.col("_done.text")).otherwise(F.col(text)))
    if counted:
        done = done.withColumn(counted, F.coalesce(F.col("_done.n"), F.lit(0)))
    return done.drop("_gaps", "_found", "_fixes", "_h1", "_h2", "_done")
