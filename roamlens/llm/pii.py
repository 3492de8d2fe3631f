"""Surrogates for personal data, in DataFrame operations only.

Found are e-mail addresses, IPv4 addresses, payment card numbers, phone numbers, social security numbers and persons named
with a title; in a text with such a person also the same name or its last word without a title. A value's canonical form (lower
case; digits alone for numbers; the name without its title) is its
identity: one identity gets one surrogate in the whole collection, whatever its spelling, and two get different ones.
A last name alone belongs to the full name of the same text that ends in it, unless the titles differ in gender; of several the first
one. A person has the gender that most of its titles have. A phone number without country code is the one with a code
when the collection has it with one code only. First names alone, and names with and without a middle name, are not joined.
A surrogate is a keyed SHA-256 of kind, identity and attempt, shaped like the identity: a digit for a digit and a
letter for a letter; e-mails keep separators and top level domain, IP parts stay 1-254, cards keep the first digit and a valid check digit,
phones keep the country code. Person names keep script (Latin, Cyrillic, Greek), capitals and number of words, and the first
name is from the title's gender. Surrogates that meet another one or a real identity of the kind are made again with the
next attempt until none does; each round is one grouped pass over the distinct identities. The text gets the digits and
letters back in each mention's own format.

The space of a shape is finite, so it grows: every ``WIDEN`` attempts an e-mail's local part gets four letters more and a person's last
name two syllables, which is 65,536 times the space; phones take other first digits than 2. So N identities need about 3 * (1 + log(N) / log(65,536)) rounds.
Social security, card and IP numbers cannot grow; what still clashes after ``ROUNDS`` rounds (more than about half of all possible numbers are in the collection) is masked: 0 for
a digit, x for a letter.

Null texts stay null and hold nothing. Very long texts are searched whole. Rows of one doc_id and text get the same result each. Null ids, extra columns and
ties do no harm; an empty table gives no rows. The order of attempts follows the identity, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import packed, read, stored

# Titles by gender, first names by gender and script.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Prof"]
FIRST = {
    ("latin", "m"): ["Adrian", "Bruno", "Conrad", "Dorian", "Emil", "Florian", "Gregor", "Hugo"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Helga"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"],
    ("greek", "m"): ["Άρης", "Γιάννης", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Μάριος", "Νίκος"],
    ("greek", "f"): ["Άννα", "Βάσω", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Νίκη"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu", "ha"],
    "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "зу", "ха"],
    "greek": ["βα", "δε", "φι", "γο", "κυ", "λα", "με", "νι", "πο", "ρυ", "σα", "τε", "βι", "χο", "ζυ", "θα"],
}

# No group is repeated without a small bound: Java matches such a group by recursion, which a long text would drive into a stack overflow.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
TITLES = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True)) + r")\.?\x20"
PERSON = r"(?<![\p{L}])" + TITLES + r"\p{Lu}\p{Ll}+(?:[\x20-]\p{Lu}\p{Ll}+){0,2}"
ANY = "|".join([EMAIL, IP, CARD, SSN, PHONE, PERSON])
WIDEN, ROUNDS = 3, 48
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|" + TITLES + r"\p{Lu}"
TITLE = f"^({TITLES})"


def kind_of(m: Column) -> Column:
    return (F.when(m.contains("@"), "email").when(m.rlike(f"^{IP}$"), "ip").when(m.rlike(f"^{CARD}$"), "card")
            .when(m.rlike(f"^{SSN}$"), "ssn").when(m.rlike(r"[0-9]"), "phone").otherwise("person"))


def identity(kind: Column, m: Column) -> Column:
    """The canonical form of one mention; a person's starts with the gender of its title."""
    title = F.regexp_replace(F.regexp_extract(m, TITLE, 1), r"[. ]", "")
    gender = F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").otherwise("x")
    name = F.lower(F.regexp_replace(m, TITLE, ""))
    return (F.when(kind == "email", F.lower(m)).when(kind == "person", F.concat(gender, F.lit(" "), name))
            .when(kind == "ip", m).otherwise(F.regexp_replace(m, r"[^0-9]", "")))


def _pick(words: list[str], byte: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (byte % len(words) + 1).cast("int"))


def _byte(h: Column, i) -> Column:
    return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")


def _shaped(value: Column, h: Column) -> Column:
    """A digit for a digit, a letter for a letter (lower case)."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def one(ch, i):
        n = F.conv(F.substring(h, (2 * (i % 31) + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + F.floor(i / 31).cast("int") * 7
        return F.when(ch.rlike("[0-9]"), (n % 10).cast("string")).when(ch.rlike("[a-z]"), F.substring(letters, (n % 26 + 1).cast("int"), F.lit(1))).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_digit(body: Column) -> Column:
    """The last digit of a 16-digit card number from the 15 before it."""
    def worth(ch, i):
        d = ch.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.split(body, ""), worth), F.lit(0), lambda a, b: a + b)
    return F.pmod(-total, F.lit(10)).cast("string")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    shaped = _shaped(value, h)
    end = F.regexp_extract(value, r"(\.[a-z]{2,})$", 1)
    wider = F.floor(attempt / WIDEN).cast("int")
    more = F.translate(F.substring(F.sha2(F.concat(h, F.lit("+")), 256), F.lit(1), F.least(4 * wider, F.lit(60))), "0123456789", "ghijklmnop")
    email = F.concat(more, _shaped(F.expr("left(value, length(value) - length(regexp_extract(value, '([.][a-z]{2,})$', 1)))"), h), end)
    ip = F.array_join(F.array(*[(_byte(h, i) % 254 + 1).cast("string") for i in range(4)]), ".")
    body = F.concat(F.substring(value, 1, 1), F.substring(shaped, 2, 14))
    card = F.concat(body, _check_digit(body))
    phone = F.concat(F.expr("left(value, greatest(length(value) - 10, 0))"), F.when(wider > 0, (_byte(h, 31) % 8 + 2).cast("string")).otherwise("2"), F.substring(F.reverse(shaped), 1, 9))
    gender = F.when(F.substring(value, 1, 1) == "f", "f").when(F.substring(value, 1, 1) == "m", "m").otherwise(F.when(_byte(h, 30) % 2 == 0, "m").otherwise("f"))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    words = F.split(F.substring(value, 3, 1000), r"[ -]")

    def last(i: int, which: str) -> Column:
        longer = [F.when(2 * wider > k, _pick(SYLLABLES[which], _byte(h, 6 + k))).otherwise("") for k in range(16)]
        return F.initcap(F.concat(*[_pick(SYLLABLES[which], _byte(h, 1 + (5 * i + k) % 28)) for k in range(5)], *longer))

    person = F.lit(None).cast("string")
    for (which, g), names in FIRST.items():
        full = F.concat_ws(" ", F.when(F.size(words) > 1, _pick(names, _byte(h, 0))), F.when(F.size(words) > 2, _pick(names, _byte(h, 29))), last(0, which))
        person = F.when((script == which) & (gender == g), full).otherwise(person)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "person", person).otherwise(shaped))


def _compared(kind: Column, low: Column) -> Column:
    """What must differ: phones may be written without country code."""
    return F.when(kind == "phone", F.right(low, F.lit(10))).otherwise(low)


def assigned(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): different surrogates for the different values of a kind, none of them a real value."""
    real = stored(values.select("kind", "value").distinct())
    bare = F.when(F.col("kind") == "person", F.expr("substring(value, 3)")).otherwise(F.col("value"))
    known = real.select("kind", _compared(F.col("kind"), bare).alias("low")).distinct()
    now = stored(real.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
    for turn in range(ROUNDS + 1):
        shown = now.withColumn("low", _compared(F.col("kind"), F.lower("surrogate")))
        shared = shown.groupBy("kind", "low").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        taken = shown.join(shared, ["kind", "low"]).filter(F.col("value") != F.col("first")).select("kind", "value")
        clash = stored(taken.unionByName(shown.join(known, ["kind", "low"], "left_semi").select("kind", "value")).distinct())
        if not clash.limit(1).count():
            return now.select("kind", "value", "surrogate")
        if turn == ROUNDS:
            masked = F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), r"\p{L}", "x")
            return now.join(clash.withColumn("left", F.lit(True)), ["kind", "value"], "left").select(
                "kind", "value", F.when(F.col("left"), masked).otherwise(F.col("surrogate")).alias("surrogate"))
        next_try = now.join(clash, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn(
            "surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
        now = stored(now.join(clash, ["kind", "value"], "left_anti").unionByName(next_try))


def _rendered(kind: Column, mention: Column, new: Column) -> Column:
    """The surrogate in the mention's format: its separators, brackets, capitals and title."""
    new = F.when(kind == "phone", F.right(new, F.length(F.regexp_replace(mention, "[^0-9]", "")))).otherwise(new)
    digits = F.array_join(F.transform(F.split(mention, ""), lambda ch, i: F.when(
        ch.rlike("[0-9]"), F.substring(new, (F.length(F.regexp_replace(F.substring(mention, F.lit(1), (i + 1).cast("int")), "[^0-9]", ""))).cast("int"), F.lit(1))).otherwise(ch)), "")
    upper = mention == F.upper(mention)
    name = F.regexp_replace(mention, TITLE, "")
    return (F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "email", F.when(upper, F.upper(new)).otherwise(new))
            .when(kind == "person", F.concat(F.regexp_extract(mention, TITLE, 1), F.when(name.contains(" "), new).otherwise(F.substring_index(new, " ", -1)))).otherwise(new))


def _names(rows: DataFrame) -> DataFrame:
    """(_d, _t, found): what to look for in the texts with titled persons, their names without title included."""
    text = F.col("row").getField("text").cast("string")
    name = F.explode(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0))).alias("m")
    titled = rows.filter(text.rlike(PERSON)).select("_d", "_t", name).select("_d", "_t", F.regexp_replace("m", TITLE, "").alias("n"))
    each = titled.select("_d", "_t", F.explode(F.array("n", F.substring_index("n", " ", -1))).alias("n"))
    longest_first = F.sort_array(F.collect_set(F.struct(F.length("n").alias("k"), "n")), asc=False)
    return each.groupBy("_d", "_t").agg(F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), F.array_join(longest_first.getField("n"), "|"), F.lit(r")(?![\p{L}])")).alias("found"))


def identified(mentions: DataFrame) -> DataFrame:
    """The mentions with ``value`` the identity in the collection: persons by name, with one gender, phones with their country code."""
    person = mentions.filter("kind = 'person'").select("_d", "_t", "i", "mention", "kind", F.substring("value", 1, 1).alias("g"), F.substring("value", 3, 1000).alias("name"))
    sexes = [F.count(F.when(F.col("g") == x, 1)) for x in "mf"]
    sex = F.when(sexes[0] > sexes[1], "m").when(sexes[0] < sexes[1], "f").otherwise("x")
    last = F.substring_index("name", " ", -1)
    full = person.filter("name like '% %'").groupBy("_d", "_t", "name").agg(sex.alias("fg"), F.min("i").alias("at")).select(
        "_d", "_t", last.alias("last"), "fg", F.struct("at", F.col("name").alias("full")).alias("p"))
    alone = person.filter("name not like '% %'").select("_d", "_t", F.col("name").alias("last"), "g").distinct().join(full, ["_d", "_t", "last"]).filter(
        "g = 'x' or fg = 'x' or g = fg").groupBy("_d", "_t", F.col("last").alias("name"), "g").agg(F.min("p").getField("full").alias("full"))
    whose = stored(person.join(alone, ["_d", "_t", "name", "g"], "left").withColumn("name", F.coalesce("full", "name")).drop("full"))
    people = whose.join(whose.groupBy("name").agg(sex.alias("sex")), "name").select("_d", "_t", "i", "mention", "kind", F.concat_ws(" ", "sex", "name").alias("value"))
    phone = mentions.filter("kind = 'phone'")
    coded = phone.filter("length(value) > 10").groupBy(F.right("value", F.lit(10)).alias("value")).agg(
        F.min("value").alias("whole"), F.max("value").alias("other")).filter("whole = other").select("value", "whole")
    phones = phone.join(coded, "value", "left").select("_d", "_t", "i", "mention", "kind", F.coalesce("whole", "value").alias("value"))
    return mentions.filter("kind not in ('person', 'phone')").unionByName(people).unionByName(phones)


def pseudonymised(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``row`` (the input columns), entities (start, end, kind, surrogate) and text (rewritten) for every document."""
    text = F.coalesce(F.col("row").getField("text").cast("string"), F.lit(""))
    hint = text.rlike(HINT)
    whole = F.when(hint, F.regexp_extract_all(text, F.col("found"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = packed(docs)
    rows = rows.join(stored(_names(rows)), ["_d", "_t"], "left").withColumn("found", F.coalesce("found", F.lit(ANY)))
    mentions = stored(rows.select("_d", "_t", whole.alias("m")).filter(F.size("m") > 0).dropDuplicates(["_d", "_t"]).select(
        "_d", "_t", F.posexplode("m").alias("i", "mention")).withColumn("kind", kind_of(F.col("mention"))).withColumn(
        "value", identity(F.col("kind"), F.col("mention"))))
    mentions = stored(identified(mentions))
    known = assigned(mentions, key)
    new = mentions.join(known, ["kind", "value"]).select("_d", "_t", F.struct(
        "i", "mention", "kind", _rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new")).alias("e"))
    per_doc = new.groupBy("_d", "_t").agg(F.sort_array(F.collect_list("e")).alias("e"))
    both = rows.join(per_doc, ["_d", "_t"], "left")
    between = F.split(text, F.col("found"), -1)
    laid = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("g"), F.col("e.new").alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit(""))))), "")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,surrogate:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["e"]["mention"])
        one = F.struct(start.alias("start"), end.alias("end"), x["e"]["kind"].alias("kind"), x["e"]["new"].alias("surrogate"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["e"].isNotNull(), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.arrays_zip(between.alias("g"), F.col("e").alias("e")), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    has = F.col("e").isNotNull()
    return both.select("row", F.when(has, found).otherwise(empty).alias("entities"), F.when(has, laid).otherwise(F.col("row").getField("text")).alias("text"))


def query(spark, folder: str) -> DataFrame:
    done = pseudonymised(read(spark, folder, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), F.size("entities").cast("long").alias("n_entities"), "entities", "text")
