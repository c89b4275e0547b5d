"""5. Personal data replaced by surrogates. DataFrame functions only.

Regular expressions find mail addresses, secrets, IP addresses of both kinds, account (IBAN), card, identity and phone numbers, and names
after a title; a full name found so is found without a title too, in the same text. Account and card numbers count only with a right
check sum. What a mention means (its value: digits without their separators, a mail
address or a name without case, a secret as it is) is one entity, and all mentions of an entity get one surrogate.

A surrogate is the value under a keyed permutation of its shape: digits stay digits, letters stay letters of their script, case and
kind (vowels, consonants), octets valid, check sums right, an account's country, a phone's country code, a secret's prefix and a domain's last part as
they were. A permutation gives distinct entities of a shape distinct surrogates, however crowded the shape is, with no draws to repeat;
it has no fixed point, so nothing stands as it was. A given name's surrogate ends as names of its gender do. The gender is the title's;
where that says none, the one that most mentions of the same full name in all documents have, else of the same given name.

Each text is searched once, and only texts with a full name are shuffled, to learn its gender.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

KEY = "matchlake"
#: Rounds of the permutation's mixing, before and after its shift.
ROUNDS = 4

FEMALE, MALE, NEUTRAL = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Mademoiselle", "Sra", "Señora", "Doña", "г-жа", "Госпожа"), ("Mr", "Herr", r"M(?=\.)", "Monsieur", "Sr", "Señor", "Don", "г-н", "Господин"), ("Dr", "Prof")
#: How surrogates of given names end, by script and gender.
ENDINGS = {"latin": {"f": "ina", "m": "ard", "n": "is"}, "cyrillic": {"f": "ина", "m": "слав", "n": "ис"}}
#: Letters that stand for one another.
CLASSES = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çñßðþ", "āăąćčďēėęěğģīįķļłńņňōőœřśşšťţūůűųźżžţș",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъьіїєґ",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ",
)
LETTERS, HEX = "".join(CLASSES), "0123456789abcdef"
STARTS = [s for s, c in zip(accumulate(map(len, CLASSES), initial=0), CLASSES, strict=False) for _ in c]
SIZES = [len(c) for c in CLASSES for _ in c]

TITLE = r"(?=[MFSDPHгГ])(?:" + "|".join((*FEMALE, *MALE, *NEUTRAL)) + r")\.? "
NAME = r"\p{Lu}[\p{L}'-]+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}(?::{GROUP}){{1,5}}|[23][0-9A-Fa-f]{{3}}|[Ff][CcDdEe][0-9A-Fa-f]{{2}})::(?:{GROUP}(?::{GROUP}){{0,4}})?)(?![0-9A-Za-z:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}| [0-9A-Z]{4}(?: (?=[A-Z]{0,3}\d)[0-9A-Z]{4}){1,6}(?: (?=[A-Z]{0,2}\d)[0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\.?\d)",
    "identity": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\d-]|\.\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE}{NAME}(?: {NAME})?",
}
ANY = "|".join(PATTERNS.values())
#: Every pattern's matches have one of these, which are found faster.
HINT = rf"[0-9@]|[A-Fa-f]:[:A-Fa-f]|[a-f]{{32}}|[A-F]{{32}}|AKIA[A-Z]|gh[opsu]_|sk-|{TITLE}\p{{Lu}}"
PREFIX = r"^(?:AKIA|gh[opsu]_|sk-)"
PERSON = rf"^{TITLE}{NAME} {NAME}$"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def number(hexadecimal: Column, i: Column) -> Column:
    """The i-th four digits of a hash, which repeats after its end."""
    return F.conv(F.substring(hexadecimal, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def lowered(x: Column) -> Column:
    """x in lower case, as many code points as before."""
    one = lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)
    return F.when(F.length(F.lower(x)) == F.length(x), F.lower(x)).otherwise(F.array_join(F.transform(chars(x), one), ""))


def mixed(x: Column, sizes: Column, salt: Column, sign: int) -> Column:
    """Rounds over the numbers x, each below its size: in each round every other number moves by a hash of the ones between. Undone by
    the same rounds backwards with the other sign."""

    def step(now: Column, turn: Column) -> Column:
        between = F.array_join(F.transform(now, lambda v, i: F.when(i % 2 == turn % 2, F.lit("")).otherwise(v.cast("string"))), ",")
        return let(F.sha2(F.concat_ws("|", salt, turn.cast("string"), between).cast("binary"), 512), lambda h: F.transform(now, lambda v, i: F.when(i % 2 == turn % 2, F.pmod(v + sign * number(h, (i / 2).cast("int")), sizes[i])).otherwise(v)))

    turns = range(ROUNDS) if sign > 0 else range(ROUNDS - 1, -1, -1)
    return F.aggregate(F.array(*map(F.lit, turns)), x, step)


def permuted(x: Column, sizes: Column, salt: Column) -> Column:
    """The numbers x, each below its size, under a permutation without fixed points: mixed, each moved by a constant, mixed back."""
    constants = F.sha2(F.concat_ws("|", salt, F.lit("shift")).cast("binary"), 512)
    moved = let(constants, lambda h: F.transform(mixed(x, sizes, salt, 1), lambda v, i: F.when(sizes[i] > 1, (v + 1 + number(h, i) % (sizes[i] - 1)) % sizes[i]).otherwise(v)))
    return let(moved, lambda m: mixed(m, sizes, salt, -1))


def surrogate_chars(text: Column, salt: Column, hexadecimal: Column) -> Column:
    """A string of the same shape; hexadecimal: of digits to f. Letters of scripts without a class of their own move among the sixteen
    of their code's row."""
    place = "struct<start:int,size:int,at:int>"
    starts, sizes_of = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>") for x in (STARTS, SIZES))

    def place_of(c: Column) -> Column:
        at = F.call_function("instr", F.lit(LETTERS), c)
        known = F.struct(F.element_at(starts, at), F.element_at(sizes_of, at), at - 1 - F.element_at(starts, at)).cast(place)
        other = F.struct(-F.ascii(c) + F.ascii(c) % 16 - 1, F.lit(16), F.ascii(c) % 16).cast(place)
        out = F.when(hexadecimal, F.struct(F.lit(0), F.lit(16), F.call_function("instr", F.lit(HEX), c) - 1).cast(place)).when(at > 0, known).when(c.rlike(r"[\p{L}\p{N}]"), other)
        return out.otherwise(F.struct(F.lit(0), F.lit(1), F.lit(0)).cast(place))

    def letter(p: Column, c: Column, y: Column) -> Column:
        own = F.decode(F.unhex(F.lpad(F.hex((-p["start"] - 1 + y).cast("long")), 8, "0")), "UTF-32")
        return F.when(p["size"] == 1, c).when(p["start"] < 0, own).when(hexadecimal, F.substring(F.lit(HEX), y + 1, F.lit(1))).otherwise(F.substring(F.lit(LETTERS), p["start"] + y + 1, F.lit(1)))

    def of(cs: Column) -> Column:
        def placed(ps: Column) -> Column:
            y = let(F.transform(ps, lambda p: p["size"]), lambda sizes: permuted(F.transform(ps, lambda p: p["at"]), sizes, salt))
            return F.array_join(F.zip_with(F.zip_with(ps, cs, lambda p, c: F.struct(p.alias("p"), c.alias("c"))), y, lambda a, b: letter(a["p"], a["c"], b)), "")

        return let(F.transform(cs, place_of), placed)

    return F.when(F.length(text) == 0, text).otherwise(let(chars(text), of))


def check_sum(numbers: Column) -> Column:
    """Luhn's sum of a string of digits, modulo 10."""
    return F.aggregate(F.transform(chars(F.reverse(numbers)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))), F.lit(0), lambda a, x: a + x) % 10


def mod_97(x: Column) -> Column:
    """A string of digits and capitals, which count from 10 for A, modulo 97."""
    return F.aggregate(chars(x), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def compact(mention: Column) -> Column:
    return F.replace(mention, F.lit(" "), F.lit(""))


def kind_of(mention: Column) -> Column:
    """Which pattern a mention matches, the first first; null for a card or account number whose check sum is wrong: that is none."""
    out = F.lit("name")
    for kind in reversed(list(PATTERNS)[:-1]):
        at = PATTERNS[kind].replace(r"(?<![\d.])", "").replace(r"(?<!\d)", "").replace(r"(?<![\d-])", "").replace(r"(?<![\p{L}\p{N}._%+-])", "")
        own = F.lit(kind)
        if kind == "card":
            own = F.when(check_sum(digits(mention)) == 0, own)
        if kind == "iban":
            own = F.when(let(compact(mention), lambda c: mod_97(F.concat(F.substring(c, 5, 99), F.substring(c, 1, 4)))) == 1, own)
        out = F.when(mention.rlike(f"^(?:{at})$"), own).otherwise(out)
    return out


def title_gender(mention: Column) -> Column:
    return F.when(mention.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), "f").when(mention.rlike(rf"^(?:{'|'.join(MALE)})\.? "), "m").otherwise("n")


def untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^{TITLE}", "")


def cased(core: Column, like: Column) -> Column:
    """core with upper case where `like` has it; beyond its end, where all of `like` is upper case."""
    return let(chars(like), lambda cs: F.array_join(F.transform(chars(core), lambda c, i: F.when(F.when(i < F.size(cs), F.get(cs, i).rlike(r"\p{Lu}")).otherwise((F.upper(like) == like) & (F.length(like) > 1)), F.upper(c)).otherwise(c)), ""))


def surrogate(mention: Column, key: str, genders: Column) -> Column:
    """struct<kind, new> of a mention; genders: a map from lowered full names to f, m or n, for where the title says none; or null."""
    cut = F.substring
    part = lambda before, body, after, salt, hexadecimal=None: F.struct(before.alias("before"), body.alias("body"), after.alias("after"), salt.alias("salt"), (F.lit(False) if hexadecimal is None else hexadecimal).alias("hexadecimal"))
    none, salt = F.lit(""), lambda kind: F.lit(f"{key}|{kind}")
    gender = F.when(title_gender(mention) == "n", F.coalesce(F.try_element_at(genders, lowered(untitled(mention))), F.lit("n"))).otherwise(title_gender(mention))
    ending = lambda w: F.element_at(F.create_map(*(F.lit(x) for script, by in ENDINGS.items() for g, e in by.items() for x in (f"{script}-{g}", e))), F.concat(F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic-").otherwise("latin-"), gender))

    def parts(kind: Column) -> Column:
        """What is permuted: one part, of a full name two; and what stays before and after it."""
        low, numbers, prefix = lowered(mention), digits(mention), F.regexp_extract(mention, PREFIX, 0)
        domain_end = F.length(F.substring_index(mention, ".", -1))  # the last part of the domain stays
        country = F.greatest(F.length(numbers) - 10, F.lit(0))  # what stands before the last ten digits
        hexadecimal = mention.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        words = F.split(untitled(mention), " ")
        name = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, part(none, lowered(w), none, salt("family"))).otherwise(part(none, lowered(w), ending(w), salt("given"))))
        one = (
            F.when(kind == "email", part(none, cut(low, F.lit(1), F.length(low) - domain_end), cut(low, F.length(low) - domain_end + 1, domain_end), salt("email")))
            .when(kind == "secret", part(prefix, F.when(hexadecimal, low).otherwise(F.regexp_replace(mention, PREFIX, "")), none, F.when(hexadecimal, salt("hex")).otherwise(F.concat(salt("secret"), prefix)), hexadecimal))
            .when(kind == "card", part(none, cut(numbers, F.lit(1), F.length(numbers) - 1), none, salt("card")))
            .when(kind == "ipv6", part(none, F.regexp_replace(low, ":", ""), none, salt("ipv6"), F.lit(True)))
            .when(kind == "iban", part(cut(mention, F.lit(1), F.lit(2)), cut(compact(mention), F.lit(5), F.lit(99)), none, F.concat(salt("iban"), cut(mention, F.lit(1), F.lit(2)))))
            .when(kind == "phone", part(cut(numbers, F.lit(1), country), cut(numbers, country + 1, F.lit(10)), none, F.concat(salt("phone"), cut(numbers, F.lit(1), country))))
            .otherwise(part(none, numbers, none, salt("identity")))
        )
        return F.when(kind == "name", name).otherwise(F.array(one))

    def written(kind: Column, cores: Column) -> Column:
        """The cores in the mention's own format: title, separators, case, check sum."""
        core = cores[0]
        core = F.when(kind == "card", F.concat(core, F.pmod(-check_sum(F.concat(core, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(core)
        rest = cut(core, F.lit(3), F.lit(99))
        core = F.when(kind == "iban", F.concat(cut(core, F.lit(1), F.lit(2)), F.lpad((98 - mod_97(F.concat(rest, cut(core, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), rest)).otherwise(core)

        def refilled(core: Column, kept: str) -> Column:
            """The mention with the core's characters, in order, in the places of those of a class."""
            return let(core, lambda k: F.array_join(F.transform(chars(mention), lambda c, i: F.when(c.rlike(f"[{kept}]"), cut(k, F.length(F.regexp_replace(cut(mention, F.lit(1), i), f"[^{kept}]", "")) + 1, F.lit(1))).otherwise(c)), ""))

        name = F.concat(F.regexp_extract(mention, f"^{TITLE}", 0), F.array_join(F.zip_with(cores, F.split(untitled(mention), " "), cased), " "))
        return F.when(kind == "email", cased(core, mention)).when(kind == "secret", F.when(mention.rlike("^[0-9A-F]+$"), F.upper(core)).otherwise(core)).when(kind == "name", name).when(kind == "ipv6", refilled(F.when(mention.rlike("[A-F]"), F.upper(core)).otherwise(core), "0-9A-Fa-f")).when(kind == "iban", refilled(core, "0-9A-Z")).otherwise(refilled(core, "0-9"))

    octets = F.transform(F.split(mention, r"\."), lambda o: o.cast("int"))
    free = lambda o: (o > 0) & (o < 255)
    ip = let(octets, lambda os: F.array_join(F.zip_with(os, let(F.transform(os, lambda o: F.when(free(o), 254).otherwise(1)), lambda sizes: permuted(F.transform(os, lambda o: F.when(free(o), o - 1).otherwise(0)), sizes, salt("ip"))), lambda o, v: F.when(free(o), v + 1).otherwise(o).cast("string")), "."))

    def of(kind: Column) -> Column:
        cores = F.transform(parts(kind), lambda p: F.concat(p["before"], surrogate_chars(p["body"], p["salt"], p["hexadecimal"]), p["after"]))
        new = F.when(kind.isNull(), mention).when(kind == "ip", ip).otherwise(let(cores, lambda cs: written(kind, cs)))
        return F.struct(kind.alias("kind"), new.alias("new"))

    return let(kind_of(mention), of)


def people(each: DataFrame) -> DataFrame:
    """(id, genders map<lowered full name, gender>) of the rows of each(id, persons array<string>) with persons, titled full names."""
    said = each.select("id", F.explode("persons").alias("mention")).select("id", lowered(untitled(F.col("mention"))).alias("person"), title_gender(F.col("mention")).alias("g"))
    votes = [F.sum((F.col("g") == g).cast("long")).alias(g) for g in "fm"]
    by_person = stored(said.groupBy("person").agg(*votes))
    by_given = by_person.groupBy(F.substring_index("person", " ", 1).alias("given")).agg(F.sum("f").alias("gf"), F.sum("m").alias("gm"))
    most = lambda f, m, none: F.when(F.col(f) > F.col(m), "f").when(F.col(m) > F.col(f), "m").otherwise(none)
    known = by_person.withColumn("given", F.substring_index("person", " ", 1)).join(by_given, "given").select("person", most("f", "m", most("gf", "gm", F.lit("n"))).alias("gender"))
    return said.select("id", "person").distinct().join(known, "person").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("person", "gender"))).alias("genders"))


def replaced(rows: DataFrame, key: str) -> DataFrame:
    """(row, new_text, kinds) of rows(row struct with text, pattern, found, genders)."""
    put = rows.select("row", F.split(F.col("row.text").cast("string"), F.col("pattern"), -1).alias("between"), F.transform("found", lambda m: surrogate(m, key, F.col("genders"))).alias("put"))
    new = F.array_join(F.zip_with("between", "put", lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    return put.select("row", new.alias("new_text"), F.filter(F.transform("put", lambda p: p["kind"]), lambda k: k.isNotNull()).alias("kinds"))


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(row, new_text, kinds) for each row of docs: the row as a struct, its text with surrogates, and the kind of each mention in order.

    Null texts stay null and texts without a mention as they are, both with empty kinds; equal texts stay equal; no documents, no rows.
    Distinct values of one shape never get equal surrogates; a surrogate may equal another entity's value, which itself is replaced.
    Columns of docs can have any names.
    """
    text = F.col("text").cast("string")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    each = stored(docs.select(F.struct("*").alias("row"), F.coalesce(found, F.array().cast("array<string>")).alias("found"), F.monotonically_increasing_id().alias("id")).withColumn("persons", F.filter("found", lambda m: m.rlike(PERSON))))
    none = each.where(F.size("found") == 0).select("row", F.col("row.text").cast("string").alias("new_text"), F.array().cast("array<string>").alias("kinds"))
    some = each.where((F.size("found") > 0) & (F.size("persons") == 0)).select("row", F.lit(ANY).alias("pattern"), "found", F.lit(None).cast("map<string,string>").alias("genders"))
    named = each.where(F.size("persons") > 0)
    named = named.join(people(named.select("id", "persons")), "id").select("row", "genders", F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?iu:"), F.array_join(F.array_distinct(F.transform("persons", untitled)), "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("pattern"))
    named = named.withColumn("found", F.regexp_extract_all(F.col("row.text").cast("string"), F.col("pattern"), F.lit(0)))
    return none.unionByName(replaced(some.unionByName(named), key))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced and n_chars (if there) counted anew; all columns and rows stay. See surrogates."""
    of = {"text": F.col("new_text"), "n_chars": F.length("new_text")}
    return surrogates(docs, key).select(*((of[c].cast(docs.schema[c].dataType) if c in of else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).alias(f"n_{kind}")
    return surrogates(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("new_text").alias("text"), F.size("kinds").alias("n_entities"), *(count(kind) for kind in PATTERNS))
