"""Surrogates for personal data, in DataFrame functions only.

Entities are found by pattern and replaced by others of the same type and
format. A surrogate is a keyed function of the entity's canonical form, so one
entity has one surrogate in all texts and in all ways of writing it. The
distinct entities of the corpus are checked: a surrogate that is itself an
entity of the corpus, or that two entities share, is drawn again for all but the
first of them, until none is left. Only the redrawn entities, few as they are,
are brought back to the texts that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bind
from inkwell.session import written

# Titles by gender, and the letters of which names are made, by script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
SCRIPTS = {
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу", ("ан", "ор", "им"), ("ана", "ия", "ина")),
    "Greek": ("βγδκλμνπρστφ", "αεηιο", ("ος", "ης", "ων"), ("ια", "ινα", "εα")),
    "Latin": ("bcdfgklmnprstv", "aeiou", ("an", "or", "ick"), ("ana", "ia", "elle")),
}
#: A name's token may have capitals and apostrophes inside (McDonald, O'Brien); initials stand before or between tokens.
TOKEN = r"\p{Lu}(?:\p{L}|['’](?=\p{L}))++(?!\.\p{Lu}\.)"
INITIALS = r"(?:\p{Lu}\.)++"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![\p{{L}}\p{{N}}_.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}_]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}_-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])",
    "iban": r"(?<![\p{L}\p{N}_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "card": r"(?<![\p{L}\p{N}_])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\p{L}\p{N}_])",
    "phone": r"(?<![\p{L}\p{N}_+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}_]|[.-]\d)",
    # As many tokens as there are; possessive, so that no shorter name is found where a digit follows.
    "name": rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? "
    rf"(?:{INITIALS} ?)*+{TOKEN}(?:[ -](?:{INITIALS}|{TOKEN}))*+(?![\p{{L}}\p{{N}}_])",
}
ENTITY = "|".join(PATTERNS.values())
TITLE = rf"^(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? "
FEMALE_TITLE = rf"^(?:{'|'.join(FEMALE)})\.? "
#: Initials written up against the token that follows are a token of their own.
INITIALED = rf"({INITIALS})(?=\p{{L}})"
#: A mention without a title; no other entity has letters only.
MENTION = r"^\p{Lu}[\p{L}'’]++(?:[ -]\p{Lu}[\p{L}'’]++)*+$"
#: A corpus with more entities of a type than free surrogates cannot keep them distinct; after so many draws it is an error.
MOST_DRAWS = 200
#: Digits of a phone number that tell it apart; what stands before is the country's.
PHONE_DIGITS = 10


def type_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email").when(e.rlike(TITLE) | e.rlike(MENTION), "name").when(e.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike("^[A-Z]"), "iban")
        .when(e.rlike(r"^(?:\d{4}[ -]){3}\d{4}$|^\d{13,19}$"), "card").otherwise("phone")
    )


def digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def name_tokens(e: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(e, TITLE, ""), INITIALED, "$1 "), "[ -]")


def members(e: Column) -> Column:
    """``type, canon`` of the parts of an entity that have surrogates of their own: the tokens of a name, else itself."""
    kind = type_of(e)
    canon = (
        F.when(kind == "email", F.lower(e)).when(kind == "ip", e).when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "phone", F.right(digits(e), F.lit(PHONE_DIGITS))).otherwise(digits(e))
    )
    given = F.when(e.rlike(FEMALE_TITLE), "given_f").otherwise("given_m")
    return F.when(
        kind == "name",
        bind(name_tokens(e), lambda t: F.transform(
            t, lambda x, i: F.struct(
                F.when(x.endswith("."), "initials").when(i == F.size(t) - 1, "surname").otherwise(given).alias("type"),
                F.lower(x).alias("canon"),
            )
        )),
    ).otherwise(F.array(F.struct(kind.alias("type"), canon.alias("canon"))))


def known_names(entities: Column) -> Column:
    """``token, type, canon`` of the name tokens among a text's entities, in their order, each once."""
    every = F.flatten(F.transform(F.filter(entities, lambda e: e.rlike(TITLE)), lambda e: F.zip_with(
        name_tokens(e), members(e), lambda t, m: F.struct(t.alias("token"), m["type"].alias("type"), m["canon"].alias("canon"))
    )))
    # Initials alone are no mention.
    return F.array_distinct(F.filter(every, lambda n: n["type"] != "initials"))


def with_mentions(names: Column) -> Column:
    """The pattern of entities and of up to three known name tokens in a row, as whole words; longer rows are several mentions."""
    # Tokens are letters and apostrophes only, so they need no quoting. Most words fail at their first letter.
    one = F.concat(F.lit(r"(?=\p{Lu})(?:"), F.array_join(F.array_distinct(names["token"]), "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    return bind(one, lambda o: F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])"), o, F.lit("(?:[ -]"), o, F.lit("){0,2}")))


def mentioned(e: Column, names: Column) -> Column:
    """``type, canon`` of the tokens of a mention without a title, as in the text's names with one.

    The last token is a surname if it is one in the text, the others are given
    names if they are; of two genders the first in the text counts.
    """
    return F.transform(F.split(e, "[ -]"), lambda t, i: bind(F.filter(names, lambda n: n["token"] == t), lambda own: bind(
        F.coalesce(F.get(F.filter(own, lambda n: (n["type"] == "surname") == (i == F.size(F.split(e, "[ -]")) - 1)), 0), F.get(own, 0)),
        lambda n: F.struct(n["type"].alias("type"), n["canon"].alias("canon")),
    )))


def drawn(seed: Column, place: Column | int, n: int) -> Column:
    """A number below ``n`` for a place of a seed."""
    return F.pmod(F.xxhash64(seed, F.lit(place) if isinstance(place, int) else place), F.lit(n)).cast("int")


def pick(letters: Column | str, at: Column) -> Column:
    return F.substr(F.lit(letters) if isinstance(letters, str) else letters, at + 1, F.lit(1))


def same_classes(text: Column, seed: Column) -> Column:
    """Letters for letters and digits for digits; other characters stay."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
        F.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", drawn(seed, i, 26)))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", drawn(seed, i, 26)))
        .when(c.rlike("[0-9]"), pick("0123456789", drawn(seed, i, 10))).otherwise(c)
    )), "")


def luhn(number: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: bind(
        F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)
    ))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def new_card(canon: Column, seed: Column) -> Column:
    """Same length and first digit; passes or fails the Luhn check as the original does."""
    body = F.concat(F.left(canon, F.lit(1)), F.substr(same_classes(canon, seed), F.lit(2), F.length(canon) - 2))
    return bind(body, lambda b: F.concat(b, (
        F.pmod(10 - luhn(F.concat(b, F.lit("0"))) + F.when(luhn(canon) == 0, 0).otherwise(1 + drawn(seed, 99, 9)), F.lit(10))
    ).cast("string")))


def new_name(canon: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    """An invented name of the same script, with an ending of the gender if it is a given name.

    Each further draw has one syllable more, so the space of names never is full.
    """

    def made(consonants: str, vowels: str, male: tuple, female: tuple) -> Column:
        syllables = [pick(s, drawn(seed, n, len(s))) for n, s in enumerate((consonants, vowels) * 2 + (consonants,))]

        def ending(choices: tuple) -> Column:
            return F.get(F.array(*map(F.lit, choices)), drawn(seed, 9, len(choices)))

        surname = F.concat(pick(vowels, drawn(seed, 7, len(vowels))), pick(consonants, drawn(seed, 8, len(consonants))))
        further = F.array_join(F.transform(F.slice(F.sequence(F.lit(10), F.lit(10) + attempt), F.lit(2), attempt), lambda n: F.concat(
            pick(consonants, drawn(seed, n * 2, len(consonants))), pick(vowels, drawn(seed, n * 2 + 1, len(vowels)))
        )), "")
        initials = F.array_join(F.transform(
            F.split(canon, ""), lambda c, n: F.when(c == ".", c).otherwise(pick(consonants, drawn(seed, n, len(consonants))))
        ), "")
        return F.when(kind == "initials", initials).otherwise(F.concat(*syllables[:-1], further, syllables[-1], F.when(kind == "given_m", ending(male)).when(kind == "given_f", ending(female)).otherwise(surname)))

    name = made(*SCRIPTS["Latin"])
    for script in ("Cyrillic", "Greek"):
        name = F.when(canon.rlike(rf"^\p{{Is{script}}}"), made(*SCRIPTS[script])).otherwise(name)
    return name


def surrogate(kind: Column, canon: Column, attempt: Column, secret: str) -> Column:
    """The canonical form of a member's surrogate."""

    def seeded(value: Column, tries: Column) -> Column:
        return F.sha2(F.concat_ws("\u0000", F.lit(secret), kind, value, tries.cast("string")), 256)

    def email(seed: Column) -> Column:
        domain = F.substring_index(canon, "@", -1)
        labels = F.split(domain, r"\.")
        host = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")
        # The domain's own seed: addresses of one domain keep a common one.
        return bind(seeded(domain, F.lit(0)), lambda own: F.concat(
            same_classes(F.substring_index(canon, "@", 1), seed), F.lit("@"),
            F.when(F.length(host) > 0, F.concat(same_classes(host, own), F.lit("."))).otherwise(""),
            F.get(F.array(*map(F.lit, ("example.com", "example.net", "example.org"))), drawn(own, 50, 3)),
        ))

    def ip(seed: Column) -> Column:
        private = F.regexp_extract(canon, r"^(10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|127\.)", 1)
        # A private range with more entities than addresses goes on in the widest one.
        private = F.when((attempt >= 8) & (F.length(private) > 0), "10.").otherwise(private)
        kept = F.when(F.length(private) > 0, private).otherwise(F.concat((11 + drawn(seed, 0, 89)).cast("string"), F.lit(".")))
        octets = F.transform(F.sequence(F.lit(1), 4 - F.size(F.split(kept, r"\.")) + 1), lambda i: (1 + drawn(seed, i, 254)).cast("string"))
        return F.concat(kept, F.array_join(octets, "."))

    def number(seed: Column) -> Column:
        first = pick("123456789", drawn(seed, 77, 9))
        return F.concat(first, F.substr(same_classes(canon, seed), F.lit(2), F.length(canon)))

    def chosen(seed: Column) -> Column:
        return (
            F.when(kind == "email", email(seed)).when(kind == "ip", ip(seed)).when(kind == "card", new_card(canon, seed))
            .when(kind == "iban", F.concat(F.left(canon, F.lit(2)), F.substr(same_classes(canon, seed), F.lit(3), F.length(canon))))
            .when(kind.isin("given_m", "given_f", "surname", "initials"), new_name(canon, kind, seed, attempt)).otherwise(number(seed))
        )

    return bind(seeded(canon, attempt), chosen)


def poured(original: Column, filling: Column, taken: str) -> Column:
    """The original with its characters of the class ``taken`` replaced, from the right, by those of ``filling``."""
    count = F.length(F.regexp_replace(original, f"[^{taken}]", ""))
    return F.array_join(F.transform(F.split(original, ""), lambda c, i: bind(
        F.length(F.regexp_replace(F.substr(original, F.lit(1), i + 1), f"[^{taken}]", "")) - count + F.length(filling),
        lambda at: F.when(c.rlike(f"[{taken}]") & (at > 0), F.substr(filling, at, F.lit(1))).otherwise(c),
    )), "")


def replacement(e: Column, attempts: Column, names: Column, secret: str) -> Column:
    """What stands for an entity or mention: its members' surrogates in the format of the original."""
    kind = type_of(e)
    untitled = ~e.rlike(TITLE) & e.rlike(MENTION)
    found = F.transform(F.when(untitled, mentioned(e, names)).otherwise(members(e)), lambda m: surrogate(
        m["type"], m["canon"], F.coalesce(F.element_at(attempts, F.concat_ws(":", m["type"], m["canon"])), F.lit(0)), secret
    ))
    title = F.regexp_extract(e, TITLE, 0)
    breaks = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(e, TITLE, ""), INITIALED, "$1 "), F.lit("[ -]"), F.lit(0))

    def form(s: Column) -> Column:
        one = F.get(s, 0)
        name = F.concat(title, F.array_join(F.flatten(F.zip_with(
            F.transform(s, lambda t: F.when(t.endswith("."), F.upper(t)).otherwise(F.initcap(t))), breaks, lambda t, b: F.array(t, F.coalesce(b, F.lit("")))
        )), ""))
        return (
            F.when(kind == "name", name).when(kind == "ip", one)
            .when(kind == "email", F.when(e == F.upper(e), F.upper(one)).otherwise(one))
            .when(kind == "iban", poured(e, one, "A-Z0-9")).otherwise(poured(e, one, "0-9"))
        )

    return bind(found, form)


def redrawn(entities: DataFrame, secret: str) -> DataFrame:
    """``type, canon, attempt`` of the entities whose first surrogate was taken.

    Each round draws for all distinct entities and redraws those in conflict; of
    entities that share a surrogate the first by canonical form keeps it.
    """
    state = written(entities.select("type", "canon", F.lit(0).alias("attempt")), "entities")
    for _ in range(MOST_DRAWS):
        drawn_ = state.withColumn("s", surrogate(F.col("type"), F.col("canon"), F.col("attempt"), secret))
        # One row per surrogate: who draws it, and whether it is an entity itself.
        sides = drawn_.select("type", F.col("s").alias("v"), "canon").unionByName(
            drawn_.select("type", F.col("canon").alias("v"), F.lit(None).cast("string").alias("canon"))
        )
        values = sides.groupBy("type", "v").agg(
            F.min("canon").alias("first"), F.count("canon").alias("n"), F.max(F.col("canon").isNull()).alias("real")
        )
        taken = written(values.where((F.col("n") > 1) | (F.col("n") > 0) & F.col("real")).drop("n"), "taken")
        if taken.isEmpty():
            return state.where(F.col("attempt") > 0)
        again = (drawn_["canon"] != F.col("first")) | F.col("real")
        state = written(
            drawn_.join(taken.withColumnRenamed("v", "s"), ["type", "s"], "left").select(
                "type", "canon", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt")
            ),
            "entities",
        )
    raise ValueError(f"no distinct surrogates in {MOST_DRAWS} draws: a type has more entities than free forms")


def entities_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def replace_entities(docs: DataFrame, secret: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """All rows and columns, with surrogates in ``text`` and the number of replaced entities in ``count``.

    NULL and empty texts stay and count 0; equal texts get equal results; an
    input column named ``count`` is replaced; a very long text is searched as a
    whole. Initials get initials, which need not be distinct. A corpus with more
    entities of a type than there are surrogates is an error. ``secret`` is the key: another key
    gives other surrogates. Names are those after a title, whose gender they
    keep, and all other mentions of their tokens in the same text that are
    written alike, as whole words; each is replaced by the same surrogate and
    counts as an entity. A name that has a title nowhere in its text is not found.
    """
    body = F.col(text)
    found = docs.select(F.explode(F.array_distinct(entities_of(body))).alias("_e"))
    distinct = found.select(F.explode(members(F.col("_e"))).alias("_m")).select("_m.type", "_m.canon").distinct()
    distinct = distinct.where("type <> 'initials'")  # too few to be distinct
    exceptions = redrawn(distinct, secret)
    rest = [c for c in docs.columns if c not in (text, count)]
    rows = docs.select(*rest, text)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    if exceptions.isEmpty():
        rows = rows.withColumn("_attempts", none)
    else:
        held = docs.select(F.xxhash64(body).alias("_k"), F.explode(F.array_distinct(entities_of(body))).alias("_e"))
        held = held.select("_k", F.explode(members(F.col("_e"))).alias("_m")).select("_k", "_m.type", "_m.canon")
        per_text = held.join(exceptions, ["type", "canon"]).groupBy("_k").agg(F.map_from_entries(
            F.collect_set(F.struct(F.concat_ws(":", "type", "canon"), "attempt"))
        ).alias("_attempts"))
        # Written, so that its size is known: where it is small no text moves.
        rows = rows.withColumn("_k", F.xxhash64(body)).join(written(per_text, "attempts"), "_k", "left").drop("_k")
        rows = rows.withColumn("_attempts", F.coalesce("_attempts", none))

    def rewritten(e: Column, names: Column, pattern: Column) -> Column:
        new = F.transform(e, lambda x: replacement(x, F.col("_attempts"), names, secret))
        gaps = F.split(body, pattern, -1)
        return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")

    def result(e: Column, names: Column, pattern: Column) -> Column:
        return F.struct(F.when(F.size(e) > 0, rewritten(e, names, pattern)).otherwise(body).alias("t"), F.size(e).cast("bigint").alias("n"))

    entities = F.coalesce(entities_of(body), F.array().cast("array<string>"))
    # Only texts with names are searched again, by a pattern of their own.
    out = bind(entities, lambda e: bind(known_names(e), lambda names: bind(
        F.when(F.size(names) > 0, with_mentions(names)).otherwise(F.lit(ENTITY)), lambda pattern: bind(
            F.when(F.size(names) > 0, F.regexp_extract_all(body, pattern, F.lit(0))).otherwise(e),
            lambda all_: result(all_, names, pattern),
        ))))
    done = rows.withColumn("_out", out)
    columns = [F.col("_out.t").alias(text) if c == text else F.col(c) for c in docs.columns if c != count]
    return done.select(*columns, F.col("_out.n").alias(count))
