"""Operator 1 [native]: PII surrogates.

Personal data is found by one pattern and replaced by keyed surrogates of the
same type and format: an e-mail stays an e-mail, a card number keeps its
layout, first digit and Luhn validity, an IBAN its country and valid check
digits, an address its octet widths, a key its prefix and alphabet, a name its
script and -- told by its title -- its gender.  Surrogates are functions of a
secret key and the entity's canonical form (case, spacing and layout taken
off), so one entity has one surrogate in the whole corpus however it is
written; names are replaced word by word, so "Mr X" and "Mr Y X" agree on X,
and a text's own name words are replaced where they stand without a title, too.

Collision check: the distinct entities are proposed surrogates; where two
entities of a type get the same, or one gets another entity's real value, all
but the first are proposed again with a higher attempt number, until none
collide.  Attempts widen names, e-mails, settings and keys, so their space does
not run out.  The other kinds have a fixed width: where a form is so crowded
that entities still collide after ``RING_AFTER`` attempts (the real values fill
a large part of all there are), those entities stand in a keyed ring by kind
and form, and each takes the real value of the next.  Only there is a
surrogate another entity's real value; it is never its own, and still distinct.

Only the documents that hold entities are exploded and joined; the join to the
surrogates is salted, since one entity may stand in a third of all documents.

Edge cases: null and empty texts, and texts without entities, pass unchanged;
a text may hold any number of entities; rows that repeat and rows with null or
equal ids are treated alike; every column of the input but the text is carried
along untouched, also one named like the count (which is then left out); an
empty table stays empty; very long texts are matched whole, in time linear in
their length.
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import ordered_index, saved, spread_join

RING_AFTER = 30           # attempts after which crowded entities of a fixed width take each other's values
WIDEN_AFTER = 3           # attempts after which e-mails, settings and keys grow by a letter each
FIXED_WIDTH = ("ipv4", "ipv6", "iban", "ssn", "card", "phone")

# ---- fixed values: forms of personal data ----
# possessive, and tried at the start of a run only: linear in the text, without recursion
HOST_LABEL = "[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@" + HOST_LABEL + "(?:\\." + HOST_LABEL + "){1,126}+"
SETTING_NAME = "(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
SETTING = "\\b" + SETTING_NAME + "\\s{0,3}[=:]\\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{6,}={0,2}"
KEY = "\\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})"
IBAN = "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b"
IPV4 = "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\\.[0-9])"
IPV6 = "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = "(?<![0-9+])\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{2,4}(?:[.-][0-9]{2,4})?" \
        "|[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3})(?![0-9]|\\.[0-9])" \
        "|(?<![0-9+])\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Doctor")
TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
NAME_WORD = "\\p{Lu}[\\p{L}'’-]*\\p{Ll}"
PERSON = "\\b(?:" + TITLES + ")\\b\\.? " + NAME_WORD + "(?: " + NAME_WORD + "){0,2}"
PII = "|".join((EMAIL, SETTING, KEY, IPV4, IPV6, IBAN, SSN, CARD, PHONE, PERSON))
#: a text without any of these holds no match of PII
HINT = "[0-9@]|" + SETTING_NAME + "|" + TITLES
# ---- fixed values: name parts by script, to build surrogate names from ----
LATIN_STEMS = ("Al", "Bren", "Cor", "Dav", "El", "Fen", "Gar", "Hol", "Iv", "Jor", "Kel", "Lor", "Mar", "Nor", "Or", "Per")
LATIN_MALE, LATIN_FEMALE = ("ric", "ton", "win", "mond", "bert", "lan", "den", "gus"), ("ina", "elle", "anna", "etta", "ika", "ora", "isa", "lia")
LATIN_FAMILY = ("ford", "well", "stein", "mont", "berg", "ley", "worth", "more")
CYRILLIC_STEMS = ("Ал", "Бор", "Вел", "Гор", "Дар", "Ев", "Жар", "Зор", "Ив", "Кар", "Лав", "Мир", "Ник", "Ол", "Пав", "Род")
CYRILLIC_MALE, CYRILLIC_FEMALE = ("ан", "ей", "ий", "ор", "им", "ик", "он", "ав"), ("ана", "ина", "ея", "ора", "има", "ика", "она", "ава")
CYRILLIC_FAMILY = ("енко", "ских", "чук", "иных", "ко", "дзе", "юк", "ых")
GREEK_STEMS = ("Αλ", "Βασ", "Γερ", "Δημ", "Ελ", "Ζαχ", "Ηλ", "Θαν", "Ιας", "Καλ", "Λεων", "Μιχ", "Νικ", "Ορ", "Παυ", "Ραφ")
GREEK_MALE, GREEK_FEMALE = ("ος", "ης", "ας", "ων", "ιος", "ινος", "ανος", "ευς"), ("ια", "ινα", "ανα", "ωνη", "ελη", "ορα", "ιδα", "ουλα")
GREEK_FAMILY = ("ίδης", "άκης", "όπουλος", "άκος", "έας", "ούδης", "ινός", "άτος")
# ---- end of fixed values ----
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdef"
SCRIPTS = {"cyrillic": (CYRILLIC_STEMS, CYRILLIC_MALE, CYRILLIC_FEMALE, CYRILLIC_FAMILY),
           "greek": (GREEK_STEMS, GREEK_MALE, GREEK_FEMALE, GREEK_FAMILY),
           "latin": (LATIN_STEMS, LATIN_MALE, LATIN_FEMALE, LATIN_FAMILY)}


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _draw(seed: Column, at, size: int) -> Column:
    """A number below ``size``, by the seed and a place."""
    return F.pmod(F.xxhash64(seed, F.lit(at) if isinstance(at, (int, str)) else at), F.lit(size)).cast("int")


def _pick(values: tuple[str, ...] | str, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), at)


def _like(value: Column, seed: Column) -> Column:
    """Each digit, lower and upper letter replaced by one of its class (hex stays hex)."""
    is_hex = value.rlike("^(?=.*[a-f])[0-9a-f:]+$")

    def one(c: Column, i: Column) -> Column:
        letter = F.when(is_hex, F.substr(F.lit(HEX), _draw(seed, i, 6) + 1, F.lit(1))).otherwise(
            F.substr(F.lit(LOWER), _draw(seed, i, 26) + 1, F.lit(1)))
        return (F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter)
                .when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _digits_like(digits: Column, seed: Column, keep: int) -> Column:
    """Digits redrawn behind the first ``keep``; the first redrawn one is 2 to 9."""
    return F.array_join(F.transform(F.split(digits, ""), lambda c, i: F.when((i < keep) | ~c.rlike("[0-9]"), c)
                                    .when(i == keep, (_draw(seed, i, 8) + 2).cast("string"))
                                    .otherwise(_draw(seed, i, 10).cast("string"))), "")


def _check_digit(payload: Column) -> Column:
    """Luhn's check digit of a string of digits."""
    doubled = F.transform(F.reverse(F.split(payload, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(
        c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(digits: Column, seed: Column) -> Column:
    drawn = _digits_like(digits, seed, 1)
    payload = F.left(drawn, F.length(drawn) - 1)
    check = _check_digit(payload)
    other = F.pmod(check + 1 + _draw(seed, "last", 9), F.lit(10))
    return F.concat(payload, F.when(_luhn(digits), check).otherwise(other).cast("string"))


def _luhn(digits: Column) -> Column:
    return F.right(digits, F.lit(1)).cast("int") == _check_digit(F.left(digits, F.length(digits) - 1))


def _iban_check(country: Column, account: Column) -> Column:
    """The check digits (mod 97) of an account."""
    number = F.concat(account, country, F.lit("00"))
    rest = F.aggregate(F.split(number, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + F.try_to_number(c, F.lit("9")).cast("int"), F.lit(97))).otherwise(
        F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _iban(value: Column, seed: Column) -> Column:
    """Same country and length, redrawn account, valid check digits."""
    country, account = F.left(value, F.lit(2)), _like(F.substr(value, F.lit(5)), seed)
    return F.concat(country, _iban_check(country, account), account)


def _octets(value: Column, seed: Column) -> Column:
    def one(part: Column, i: Column) -> Column:
        return (F.when(F.length(part) == 1, _draw(seed, i, 9) + 1).when(F.length(part) == 2, _draw(seed, i, 90) + 10)
                .otherwise(F.when(i == 0, _draw(seed, i, 92) + 130).otherwise(_draw(seed, i, 155) + 100)))
    return F.array_join(F.transform(F.split(value, "\\."), one), ".")


def _email(value: Column, seed: Column) -> Column:
    """Redrawn local part and host labels; the reserved names at the end stay, others become .example."""
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    reserved = host.rlike("(^|\\.)example\\.(com|org|net)$")
    labels = F.split(host, "\\.")
    n = F.size(labels) - F.when(reserved, 2).otherwise(1)
    drawn = F.transform(F.slice(labels, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: _like(x, F.concat(seed, i.cast("string"))))
    ends = F.when(reserved, F.slice(labels, F.size(labels) - 1, F.lit(2))).otherwise(F.array(F.lit("example")))
    return F.concat(_like(local, seed), F.lit("@"), F.array_join(F.concat(drawn, ends), "."))


def _name(value: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    """A name word of the value's script; kind is given-m, given-f or family."""
    def built(script: str) -> Column:
        stems, male, female, family = SCRIPTS[script]
        either = male + female  # a title that tells no gender
        ends = (F.when(kind == "given-m", _pick(male, _draw(seed, "e", len(male)))).when(kind == "given-f", _pick(female, _draw(seed, "e", len(female))))
                .when(kind == "given", _pick(either, _draw(seed, "e", len(either)))).otherwise(_pick(family, _draw(seed, "e", len(family)))))
        middle = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i == 0, "").otherwise(
            F.lower(_pick(stems, _draw(seed, i, len(stems)))))), "")
        return F.concat(_pick(stems, _draw(seed, "s", len(stems))), middle, ends)
    return (F.when(value.rlike("\\p{IsCyrillic}"), built("cyrillic")).when(value.rlike("\\p{IsGreek}"), built("greek"))
            .otherwise(built("latin")))


def _entities(match: Column) -> Column:
    """(kind, canon) of the entities in one match: one for each word of a name, else one."""
    words = F.split(F.regexp_replace(match, "^[^ ]+ ", ""), " ")
    entity = lambda kind, canon: F.struct(kind.alias("kind"), canon.alias("canon"))
    gender = (F.when(match.rlike("^(" + "|".join(FEMALE_TITLES) + ")\\b"), "given-f")
              .when(match.rlike("^(" + "|".join(MALE_TITLES) + ")\\b"), "given-m").otherwise("given"))
    names = F.transform(words, lambda w, i: entity(F.when(i == F.size(words) - 1, "family").otherwise(gender), w))
    digits = F.regexp_replace(match, "[^0-9]", "")
    one = lambda kind, canon: F.array(entity(F.lit(kind), canon))
    return (F.when(match.contains("@"), one("email", F.lower(match)))
            .when(match.rlike("^" + SETTING), one("setting", F.regexp_extract(match, "^" + SETTING_NAME + "\\s{0,3}[=:]\\s{0,3}[\"']?(.*)$", 1)))
            .when(match.rlike("^" + KEY), one("key", match))
            .when(match.rlike(whole(IPV4)), one("ipv4", match))
            .when(match.rlike(whole(IPV6)), one("ipv6", F.lower(match)))
            .when(match.rlike(whole(IBAN)), one("iban", F.replace(match, F.lit(" "), F.lit(""))))
            .when(match.rlike(whole(SSN)), one("ssn", digits))
            .when(match.rlike(whole(CARD)), one("card", digits))
            .when(match.rlike("^[+(0-9]"), one("phone", F.regexp_replace(match, "[^0-9+]", "")))
            .otherwise(names))


def _wider(seed: Column, attempt: Column) -> Column:
    """Letters that late attempts put before a value."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(attempt - WIDEN_AFTER, F.lit(0))), lambda i: F.when(i == 0, "").otherwise(
        F.substr(F.lit(LOWER), _draw(seed, F.concat(F.lit("w"), i.cast("string")), 26) + 1, F.lit(1)))), "")


def _proposal(key: str) -> Column:
    """Canonical surrogate of the columns kind, canon, attempt."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 256)
    prefix = F.regexp_extract(canon, "^(AKIA|gh[pousr]_|sk-|xox[abpr]-)", 1)
    wider = _wider(seed, attempt)
    return (F.when(kind == "email", F.concat(wider, _email(canon, seed)))
            .when(kind == "key", F.concat(prefix, wider, _like(F.substr(canon, F.length(prefix) + 1), seed)))
            .when(kind == "ipv4", _octets(canon, seed)).when(kind == "iban", _iban(canon, seed))
            .when(kind == "ssn", _digits_like(canon, seed, 0)).when(kind == "card", _card(canon, seed))
            .when(kind == "phone", _digits_like(canon, seed, 2)).when(kind == "ipv6", _like(canon, seed))
            .when(kind == "setting", F.concat(wider, _like(canon, seed)))
            .otherwise(_name(canon, kind, seed, attempt)))


def _form(kind: Column, canon: Column) -> Column:
    """What a surrogate of a fixed width keeps of its value: two values of one form may stand for each other."""
    classes = F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "[a-z]", "a")
    account = F.substr(canon, F.lit(5))
    iban = F.concat(F.left(canon, F.lit(2)), (F.substr(canon, F.lit(3), F.lit(2)) == _iban_check(F.left(canon, F.lit(2)), account)).cast("string"),
                    F.regexp_replace(F.regexp_replace(account, "[0-9]", "0"), "[A-Z]", "A"))
    return (F.when(kind == "iban", iban).when(kind == "card", F.concat_ws("|", F.left(canon, F.lit(1)), F.length(canon), _luhn(canon)))
            .when(kind == "phone", F.concat_ws("|", F.left(canon, F.lit(2)), F.length(canon)))
            .otherwise(classes))


def _rings(judged: DataFrame, key: str) -> DataFrame:
    """(kind, canon, ring) of the entities that still collide and have a fixed
    width, with one settled entity of each form among them: the next one's
    real value.  An entity alone in its form is left out."""
    placed = saved(judged.filter(F.col("kind").isin(*FIXED_WIDTH)).select(
        "kind", "canon", "again", _form(F.col("kind"), F.col("canon")).alias("form"),
        F.sha2(F.concat_ws("|", F.lit(key), F.lit("ring"), "kind", "canon"), 256).alias("place")), "forms")
    left = placed.filter("again").select("kind", "form").distinct()
    mates = (placed.filter("not again").join(left, ["kind", "form"], "left_semi").groupBy("kind", "form")
             .agg(F.min(F.struct("place", "canon")).alias("mate")).select("kind", "mate.canon", "form", "mate.place"))
    members = placed.filter("again").select("kind", "canon", "form", "place").unionByName(mates)
    order = [F.col(c) for c in ("kind", "form", "place", "canon")]
    ring = saved(ordered_index(members, order, "ring-order", "at"), "ring")
    ends = ring.groupBy("kind", "form").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi")
    return (spread_join(ring, ends, ["kind", "form"], ["canon"])
            .select("kind", "canon", F.when(F.col("at") == F.col("hi"), F.col("lo")).otherwise(F.col("at") + 1).alias("next"))
            .join(ring.select(F.col("at").alias("next"), F.col("canon").alias("ring")), "next").select("kind", "canon", "ring"))


def assign(entities: DataFrame, key: str, most_attempts: int = RING_AFTER) -> DataFrame:
    """(kind, canon, surrogate) with distinct surrogates per kind, none its own
    value, and none another's real value but in rings (see above)."""
    ring = F.lit(None).cast("string").alias("ring")
    entities = saved(entities.select("kind", "canon").distinct().select("*", F.lit(0).alias("attempt"), ring), "entities")
    for attempt in itertools.count(1):
        proposed = saved(entities.withColumn("surrogate", F.coalesce("ring", _proposal(key))), "proposals")
        first = proposed.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        judged = (proposed.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
                  .withColumn("again", F.col("ring").isNull() & (F.coalesce("real", F.lit(False)) | (F.col("first.canon") != F.col("canon")))))
        if judged.filter("again").isEmpty():
            return proposed.select("kind", "canon", "surrogate")
        told = judged.select("kind", "canon", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "ring", "again")
        if attempt == most_attempts:
            told = told.drop("ring").join(_rings(told, key), ["kind", "canon"], "left")
        entities = saved(told.select("kind", "canon", "attempt", "ring"), "entities")


def _laid_out(match: Column, surrogates: Column) -> Column:
    """The surrogates written in the match's own layout."""
    first = F.get(surrogates, F.lit(0))
    kind, value = first["kind"], first["surrogate"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    by_digit = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(
        digits, F.length(F.regexp_replace(F.left(match, i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    by_sign = F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(c != " ", F.substr(
        value, F.length(F.replace(F.left(match, i + 1), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(c)), "")
    setting = F.concat(F.regexp_extract(match, "^(" + SETTING_NAME + "\\s{0,3}[=:]\\s{0,3}[\"']?)", 1), value)
    title = F.regexp_extract(match, "^([^ ]+ )", 1)
    return (F.when(kind == "email", F.when((F.upper(match) == match) & (F.lower(match) != match), F.upper(value)).otherwise(value))
            .when(kind == "setting", setting).when(kind.isin("key", "ipv4", "ipv6"), value)
            .when(kind == "iban", by_sign).when(kind.isin("ssn", "card", "phone"), by_digit)
            .otherwise(F.concat(title, F.array_join(F.transform(surrogates, lambda s: s["surrogate"]), " "))))


def has_pii(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(PII), F.lit(False))


WORD = "\\p{L}[\\p{L}'’-]*\\p{L}|\\p{L}|[^\\p{L}]++"  # words, and what lies between


def _with_mentions(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(row_id, said): the gaps of rows that name people, with their name words replaced
    there, too: whoever was named with a title stays the same person without it.

    Words are joined to the row's own names; a word that is two kinds of name is
    taken as it came first."""
    names = (placed.filter(F.col("kind").startswith("given") | (F.col("kind") == "family"))
             .groupBy("row_id", F.col("canon").alias("word")).agg(F.min_by("surrogate", F.struct("at", "part")).alias("surrogate")))
    gaps = found.join(names.select("row_id").distinct(), "row_id", "left_semi").select("row_id", F.posexplode("gaps").alias("at", "gap"))
    words = gaps.select("row_id", "at", F.posexplode_outer(F.regexp_extract_all("gap", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    said = words.join(names, ["row_id", "word"], "left").groupBy("row_id", "at").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("surrogate", "word").alias("word")))).alias("words"))
    said = said.select("row_id", "at", F.array_join(F.transform("words", lambda w: w["word"]), "").alias("gap"))
    return said.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "gap"))), lambda g: g["gap"]).alias("said"))


def replace_pii(docs: DataFrame, key: str, count_as: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of its text replaced, and their number as ``count_as``.

    A column of that name in ``docs`` stays as it is, and the number is left out."""
    columns = docs.columns
    counted = count_as not in columns
    found = saved(
        docs.filter(has_pii(F.col("text")))
        .select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.monotonically_increasing_id().alias("row_id"),
                F.split("text", PII, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(PII), F.lit(0)).alias("matches"))
        .withColumn("entities", F.flatten(F.transform("matches", lambda m, i: F.transform(
            _entities(m), lambda e, j: F.struct(i.alias("at"), j.alias("part"), e["kind"].alias("kind"), e["canon"].alias("canon")))))),
        "pii-rows")
    spots = found.select("row_id", F.explode("entities").alias("e")).select("row_id", "e.*")
    surrogates = assign(spots.select("kind", "canon"), key)
    placed = saved(spread_join(spots, surrogates, ["kind", "canon"], ["row_id", "at"]), "placed")
    by_match = placed.groupBy("row_id", "at").agg(F.array_sort(F.collect_list(F.struct("part", "kind", "surrogate"))).alias("new"))
    by_row = by_match.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda m: m["new"]).alias("placed"))
    parts = F.transform(F.coalesce("said", "gaps"), lambda gap, i: F.when(i < F.size("matches"), F.concat(
        gap, _laid_out(F.get("matches", i), F.get("placed", i)))).otherwise(gap))
    done = found.join(by_row, "row_id").join(_with_mentions(found, placed), "row_id", "left").select(
        *(F.array_join(parts, "").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in columns),
        *([F.size("matches").cast("long").alias(count_as)] if counted else []))
    rest = docs.filter(~has_pii(F.col("text")))
    return rest.select("*", *([F.lit(0).cast("long").alias(count_as)] if counted else [])).union(done)
