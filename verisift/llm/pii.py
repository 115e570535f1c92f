"""PII surrogates, on DataFrame functions alone.

One pattern finds the entities of a text; each gets a surrogate of its own
type and form: digits for digits, letters for letters of the same case, card
numbers that pass the check sum if the original did, addresses of valid
numbers, streets and dates of birth of the same form, persons' names of the same
gender and script.  A surrogate is a keyed digest (SHA-256) of type and
normalised entity, so the same entity has the same one in every document, and
nobody without the key can go back.

Persons are found by a title or by words such as "my name is".  Each word of a
name has a surrogate of its own, first names by gender, so parts of a name agree
with the whole; and wherever a document names a person, its other mentions of
those words, bare or in part, are replaced alike.

Collisions are checked over the whole corpus, all types and all spellings of an
entity: two entities of one surrogate, or a surrogate that is some entity's real
value, are tried again with another number until none is left, the smallest
entity keeping what it has.  A word of a person's name or a street gets a further
name with each try; short mail names, secrets and phone numbers grow from the
fourth on, dates of birth get any year of four digits from the fourth on, and
these and numbers of a fixed form grow by digits from the ninth on, so there is
always room and an end.  A date of birth is one entity in all its forms, read day
first, but a year of two digits isn't one of four.  Only these exceptions
are ever joined to documents, by row, broadcast only if Spark finds the written
table small enough; all else is computed in the row.

Defined results: a null text stays null; an empty one empty; repeated rows get
the same text; text outside entities isn't touched; other columns stay, whatever
they are called; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.scratch import discard, materialize

#: First names by script and gender, and family names by script.
NAMES = {
    ("latin", "m"): "Adam Bruno Daniel Emil Felix Henri Jonas Lukas Marco Oscar Paul Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Clara Diana Elena Emma Irene Julia Laura Maria Nina Olivia Rosa Sara Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Денис Иван Максим Олег Павел Сергей Юрий".split(),
    ("cyrillic", "f"): "Алла Вера Елена Ирина Лидия Мария Нина Ольга Софья Юлия".split(),
    ("greek", "m"): "Αντώνης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Κατερίνα Μαρία Σοφία".split(),
}
FAMILIES = {
    "latin": "Alder Berger Castell Dorn Engel Falk Garnier Hale Lindner Marin Novak Orsini Prado Quint Rossi Sandoval Tanner Vidal Weber York".split(),
    "cyrillic": "Белов Волков Громов Жуков Зимин Крылов Лебедев Морозов Орлов Соколов".split(),
    "greek": "Αλεξίου Βασιλείου Γεωργίου Δήμου Ιωάννου Νικολάου Παππάς Σταύρου".split(),
}
#: Titles by gender; a name is what follows one of them.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "г-н", "Κος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа", "Κα"]}

_NAME = r"\p{Lu}[\p{L}'\-]+"
#: Words that announce a name, or a date of birth; kinds of streets (fixed values).
_SAYS = r"[Mm]y name is |[Ii]ch hei(?:ß|ss)e |[Jj]e m'appelle |[Mm]e llamo |меня зовут "
_SAID = rf"(?=\p{{Lu}})(?<={_SAYS})"
_BORN = r"(?=\d)(?<=(?i:born on |born |birth: |dob: |birthday: |geboren am |né le |née le ))"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./](?:\d{4}|\d{2}))(?!\d)"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square|Way"
_STRASSE = "straße|strasse|gasse|weg|allee|platz"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted(TITLES["m"] + TITLES["f"], key=len, reverse=True))
#: Types in the order in which they are tried, and their patterns (Java).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_\-+/]*\d)[A-Za-z0-9_\-+/]{6,}=*[\"']?",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.\-])(?:[3-6]\d{3}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?![\d\-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "dob": rf"{_BORN}{_DATE}",
    "address": rf"(?=[\d\p{{Lu}}])(?<![\p{{L}}\d])(?:\d{{1,5}} (?:{_NAME} ){{1,3}}(?:{_STREET})(?![\p{{L}}])|\p{{Lu}}[\p{{L}}\-]*+(?<={_STRASSE}) \d{{1,4}}[a-z]?(?![\p{{L}}\d])|\d{{1,4}},? rue (?:[\p{{L}}'\-]+ ){{0,3}}{_NAME}|(?:Calle|Avenida) (?:[\p{{L}}'\-]+ ){{0,3}}{_NAME},? \d{{1,4}}(?!\d))",
    "person": rf"(?=\p{{Lu}}|г)(?:(?<![\p{{L}}])(?:{_TITLE})\.? |{_SAID}){_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The patterns of entities that stand alone, without the words before them.
FORMS = {k: p for k, p in PATTERNS.items() if k != "person"} | {"dob": _DATE}
#: What every text with an entity has, and a quick look tells: a digit, an @ or a title.
GATE = rf"[0-9@]|(?=[MmIiJjм])(?:{_SAYS})\p{{Lu}}|(?=[{''.join(sorted({t[0] for t in TITLES['m'] + TITLES['f']}))}])(?:{_TITLE})\.? \p{{Lu}}"
#: Tries of the entity's own length; each one after that adds a character to mail names, secrets and phone numbers.
TRIES = 3
#: The same for types of a fixed number of digits.
LATE = 8
#: What stays in front of a secret.
SECRET_HEAD = r"^[A-Za-z_\-]+\s*[=:]\s*[\"']?"


NO_TEXTS = "cast(array() as array<string>)"


def _plain_name(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", "")


def _read(text: Column) -> Column:
    """(found, pattern, families, women, men): the entities of a text in order, the pattern that finds them, the last words of its persons' names, and all words of women's and men's.

    Where a person is named, the words of the name are looked for all over the text.
    """

    def told(first: Column) -> Column:
        def people(named: Column) -> Column:
            def titled(gender: str) -> Column:
                theirs = F.filter(named, lambda e: F.regexp_like(e, F.lit(f"^(?:{'|'.join(TITLES[gender[0].replace('w', 'f')])})[. ]")))
                return F.array_distinct(F.flatten(F.transform(theirs, lambda e: F.split(_plain_name(e), " "))))

            names = F.transform(named, lambda e: F.split(_plain_name(e), " "))
            words = F.array_join(F.array_sort(F.array_distinct(F.flatten(names)), lambda x, y: F.length(y) - F.length(x)), "|")
            pattern = F.when(F.size(named) == 0, F.lit(ANY)).otherwise(F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), words, F.lit(")(?: (?:"), words, F.lit(r"))*(?![\p{L}])")))

            def again(p: Column) -> Column:
                return F.struct(
                    F.when(F.size(named) == 0, first).otherwise(F.regexp_extract_all(text, p, F.lit(0))).alias("found"), p.alias("pattern"),
                    F.array_distinct(F.transform(names, lambda n: F.element_at(n, -1))).alias("families"), *(titled(g).alias(g) for g in ("women", "men")),
                )

            return _let(pattern, again)

        return _let(F.filter(first, lambda e: kind(e) == "person"), people)

    return _let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), told)


def entities(text: Column) -> Column:
    """All entities of a text; the patterns only run where the quick look finds something."""
    return F.when(F.regexp_like(text, F.lit(GATE)), _read(text)["found"]).otherwise(F.expr(NO_TEXTS))


def _words(entity: Column, read: Column) -> Column:
    """(kind, entity, normal) of each word of a person's name: a family name if the text has it as one, else a first name of a woman or man."""

    def word(w: Column) -> Column:
        woman = F.array_contains(read["women"], w) | (~F.array_contains(read["men"], w) & F.regexp_like(w, F.lit("[aаαά]$")))
        of = F.when(F.array_contains(read["families"], w), "family").when(woman, "woman").otherwise("man")
        return F.struct(of.alias("kind"), w.alias("entity"), w.alias("normal"))

    return F.transform(F.split(_plain_name(entity), " "), word)


def _parts(entity: Column, read: Column) -> Column:
    """(kind, entity, normal) of what gets a surrogate of its own: the words of a name, else the entity."""

    def told(of: Column) -> Column:
        whole = F.array(F.struct(of.alias("kind"), entity.alias("entity"), normal(entity, of).alias("normal")))
        return F.when(of == "person", _words(entity, read)).otherwise(whole)

    return _let(kind(entity), told)


def kind(entity: Column) -> Column:
    return F.coalesce(*(F.when(F.regexp_like(entity, F.lit(f"^(?:{p})$")), k) for k, p in FORMS.items()), F.lit("person"))


def normal(entity: Column, of: Column) -> Column:
    """What is equal for mentions of one entity: case of mail addresses, spacing of numbers and the form of a date don't matter."""
    date = F.regexp_replace(F.regexp_replace(entity, r"^(\d+)[./](\d+)[./](\d+)$", "$3-$2-$1"), r"(?<!\d)(\d)(?!\d)", "0$1")
    return (
        F.when(of == "email", F.lower(entity))
        .when(of.isin("card", "iban", "phone", "ssn"), F.regexp_replace(entity, r"[^0-9A-Z+]", ""))
        .when(of == "secret", F.regexp_replace(F.regexp_replace(entity, SECRET_HEAD, ""), "[\"']$", ""))
        .when(of == "dob", date)
        .otherwise(entity)
    )


def _byte(stream: Column, i: Column) -> Column:
    """A number below 256 out of 64 hexadecimal digits, by position."""
    return F.conv(F.substring(stream, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")


def _overlaid(text: Column, stream: Column) -> Column:
    """Each digit and letter of ASCII replaced by another of its kind, the rest as it is; separators aren't counted, so two spellings agree."""

    def one(acc: Column, c: Column) -> Column:
        n = F.pmod(_byte(stream, acc["n"]) + acc["n"] * 7, F.lit(256))
        new = (
            F.when(F.regexp_like(c, F.lit("[0-9]")), F.pmod(n, F.lit(10)).cast("string"))
            .when(F.regexp_like(c, F.lit("[a-z]")), F.char(F.pmod(n, F.lit(26)) + 97))
            .when(F.regexp_like(c, F.lit("[A-Z]")), F.char(F.pmod(n, F.lit(26)) + 65))
            .otherwise(c)
        )
        return F.struct(F.concat(acc["text"], new).alias("text"), (acc["n"] + F.regexp_like(c, F.lit("[0-9A-Za-z]")).cast("int")).alias("n"))

    return F.aggregate(F.split(text, "(?!^)"), F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), one)["text"]


def _luhn(digits: Column) -> Column:
    """The sum of the check of a card number, its last digit included, modulo 10."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.pmod(F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)), F.lit(10))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _card(entity: Column, stream: Column) -> Column:
    """The first digit stays; the last one is set so that the check sum passes if it did before, and doesn't otherwise."""
    def fixed(new: Column) -> Column:
        old_ok = _luhn(F.regexp_replace(entity, r"\D", "")) == 0
        body = F.substring(new, F.lit(1), F.length(new) - 1)
        due = F.pmod(10 - _luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))), F.lit(10))
        last = F.when(old_ok, due).otherwise(F.pmod(due + 1 + F.pmod(_byte(stream, F.lit(30)), F.lit(9)), F.lit(10)))
        return F.concat(body, last.cast("string"))

    return _let(F.concat(F.substring(entity, 1, 1), F.substring(_overlaid(entity, stream), F.lit(2), F.length(entity))), fixed)


def _pick(names: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))))


def _more(names: list[str], ending: Column, stream: Column, attempt: Column) -> Column:
    """A further name for each try after the first."""
    more = F.transform(F.sequence(F.lit(1), attempt), lambda i: F.concat(F.lit("-"), _pick(names, _byte(stream, i + 6)), ending))
    return F.when(attempt > 0, F.array_join(more, "")).otherwise("")


def _named(word: Column, of: Column, stream: Column, attempt: Column) -> Column:
    """A word of a name: a first name of the same gender, or two family names, in the word's script."""
    script = F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(word, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
    number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
    out = F.lit("")
    for s, families in FAMILIES.items():
        ending = F.when(F.regexp_like(word, F.lit("[оеи]ва$|ина$")), "а").otherwise("")
        # two family names make room for more persons than there are names
        family = F.concat(_pick(families, F.floor(number / 64)), ending, F.lit("-"), _pick(families, F.floor(number / 4096)), ending, _more(families, ending, stream, attempt))
        first = {g: F.concat(_pick(NAMES[s, g], number), _more(NAMES[s, g], F.lit(""), stream, attempt)) for g in "fm"}
        out = F.when(script == s, F.when(of == "family", family).when(of == "woman", first["f"]).otherwise(first["m"])).otherwise(out)
    return out


def _address(entity: Column, stream: Column, attempt: Column) -> Column:
    """The kind of street stays, its name and number don't."""
    number = F.conv(F.substring(stream, 1, 12), 16, 10).cast("long")
    name = F.concat(_pick(FAMILIES["latin"], number), _more(FAMILIES["latin"], F.lit(""), stream, attempt))
    places = rf"(?:{_NAME} )+(?=(?:{_STREET})(?![\p{{L}}]))", rf"^\p{{Lu}}[\p{{L}}\-]*?(?=(?:{_STRASSE}) )", rf"{_NAME}$|{_NAME}(?=,? \d)"
    kinds = rf" (?:{_STREET})$", rf"(?:{_STRASSE}) \d", "^"
    named = F.coalesce(*(F.when(F.regexp_like(entity, F.lit(k)), F.regexp_replace(entity, F.lit(p), F.concat(name, F.lit(" " if i == 0 else "")))) for i, (p, k) in enumerate(zip(places, kinds, strict=True))))
    return F.regexp_replace(named, F.lit(r"\d+"), (F.pmod(F.floor(number / 64), F.lit(199)) + 1).cast("string"))


def _date(entity: Column, stream: Column, attempt: Column) -> Column:
    """Another day in the same form; after the first tries of any year of four digits, later of more."""
    wide = attempt > TRIES
    of_any = F.pmod(F.conv(F.substring(stream, 33, 12), 16, 10).cast("long"), F.lit(9000)) + 1000
    more = F.when(attempt > LATE, _overlaid(F.repeat(F.lit("0"), F.greatest(attempt - LATE, F.lit(0))), stream)).otherwise("")
    year = F.concat(F.when(wide, of_any).otherwise(F.pmod(_byte(stream, F.lit(0)), F.lit(60)) + 1940).cast("string"), more)
    month, day = (F.lpad((F.pmod(_byte(stream, F.lit(i)), F.lit(n)) + 1).cast("string"), 2, "0") for i, n in ((3, 12), (6, 28)))
    sep = F.regexp_extract(entity, r"[./]", 0)
    short = F.when(~wide & F.regexp_like(entity, F.lit(r"[./]\d{2}$")), F.substring(year, F.lit(3), F.length(year))).otherwise(year)
    return F.when(F.regexp_like(entity, F.lit(r"^\d{4}-")), F.concat_ws("-", year, month, day)).otherwise(F.concat(day, sep, month, sep, short))


def surrogate(entity: Column, of: Column, attempt: Column, key: str) -> Column:
    stream = F.sha2(F.concat_ws("|", F.lit(key), of, normal(entity, of), attempt.cast("string")), 256)
    grown, late = F.greatest(attempt - TRIES, F.lit(0)), F.greatest(attempt - LATE, F.lit(0))

    def made(s: Column) -> Column:
        head = F.regexp_extract(entity, SECRET_HEAD, 0)
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(s, i * 3), F.lit(254)) + 1).cast("string")), ".")
        domain = F.regexp_extract(entity, r"@(.*)\.[^.]+$", 1)
        return (
            F.when(of == "email", F.concat(_overlaid(F.concat(F.regexp_extract(entity, "^[^@]*", 0), F.repeat(F.lit("a"), grown)), s), F.lit("@"), _overlaid(domain, F.sha2(F.concat(F.lit(key), F.lower(domain)), 256)), F.regexp_extract(entity, r"\.[^.]+$", 0)))
            .when(of == "secret", F.concat(head, _secret(F.concat(F.repeat(F.lit("0"), grown), F.substring(entity, F.length(head) + 1, F.length(entity))), s)))
            .when(of == "key", F.concat(F.substring(entity, 1, 4), _overlaid(F.substring(entity, F.lit(5), F.lit(16)), s)))
            .when(of == "iban", F.concat(F.substring(entity, 1, 2), _overlaid(F.concat(F.substring(entity, F.lit(3), F.length(entity)), F.repeat(F.lit("0"), late)), s)))
            .when(of == "card", _card(F.concat(entity, F.repeat(F.lit("0"), late)), s))
            .when(of == "ip", F.concat(octets, F.when(late > 0, F.concat(F.lit(":"), _overlaid(F.repeat(F.lit("0"), late), s))).otherwise("")))
            .when(of == "phone", _phone(F.concat(entity, F.repeat(F.lit("0"), grown)), s))
            .when(of.isin("family", "woman", "man"), _named(entity, of, s, attempt))
            .when(of == "address", _address(entity, s, attempt))
            .when(of == "dob", _date(entity, s, attempt))
            .otherwise(_overlaid(F.concat(entity, F.repeat(F.lit("0"), late)), s))
        )

    return _let(stream, made)


def _secret(text: Column, stream: Column) -> Column:
    """Hexadecimal stays hexadecimal."""
    new = _overlaid(text, stream)
    folded = F.translate(new, "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")
    return F.when(F.regexp_like(text, F.lit("^[0-9a-f]+[\"']?$")), folded).otherwise(new)


def _phone(entity: Column, stream: Column) -> Column:
    """The country code stays."""
    head = F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .\-(])", 0)
    return F.concat(head, _overlaid(F.substring(entity, F.length(head) + 1, F.length(entity)), stream))


def _found(text: Column) -> Column:
    """(kind, entity, normal) of all that gets a surrogate in a text."""
    return F.when(F.regexp_like(text, F.lit(GATE)), _let(_read(text), lambda r: F.flatten(F.transform(r["found"], lambda e: _parts(e, r))))).otherwise(
        F.expr("cast(array() as array<struct<kind:string,entity:string,normal:string>>)")
    )


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, entity, normal)`` of every mention."""
    return docs.select(F.explode(_found(F.col(text_col).cast("string"))).alias("e")).select("e.kind", "e.entity", "e.normal")


def exceptions(mentions: DataFrame, key: str) -> DataFrame:
    """``(kind, normal, attempt)`` of the entities whose first surrogate is taken, or real.

    Every type is held against every other, and an entity by the surrogates of all its spellings.
    """
    known = materialize(mentions.select("kind", "entity", "normal").distinct(), "entities")
    shown = _let(surrogate(F.col("entity"), F.col("kind"), F.col("attempt"), key), lambda s: normal(s, F.col("kind")))
    now = materialize(known.withColumn("attempt", F.lit(0)).withColumn("shown", shown), "surrogates")
    while True:
        real = now.join(known.select(F.col("normal").alias("shown")), "shown", "left_semi").select("kind", "normal")
        first = now.groupBy("shown").agg(F.min(F.struct("attempt", "kind", "normal")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        taken = now.join(first, "shown").filter("first.kind <> kind or first.normal <> normal").select("kind", "normal")
        clash = materialize(real.union(taken).distinct().withColumn("clash", F.lit(True)), "clashes")
        if clash.isEmpty():
            return now.filter("attempt > 0").select("kind", "normal", "attempt").distinct()
        again = now.join(clash, ["kind", "normal"], "left").withColumn("attempt", F.col("attempt") + F.coalesce(F.col("clash").cast("int"), F.lit(0)))
        after = materialize(again.withColumn("shown", F.when(F.col("clash"), shown).otherwise(F.col("shown"))).drop("clash"), "surrogates")
        discard(now)
        now = after


def _rewritten(text: Column, tried: Column, key: str) -> Column:
    """(text with surrogates, number of entities); ``tried``: map from kind|normal to attempts, or null."""

    def part(p: Column) -> Column:
        attempts = F.map_values(F.map_filter(tried, lambda x, _: x == F.concat_ws("|", p["kind"], p["normal"])))
        return surrogate(p["entity"], p["kind"], F.coalesce(F.get(attempts, F.lit(0)), F.lit(0)), key)

    def put(read: Column) -> Column:
        def one(e: Column) -> Column:
            title = F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0)
            return _let(_parts(e, read), lambda ps: F.concat(F.when(F.get(ps, F.lit(0))["kind"].isin("family", "woman", "man"), title).otherwise(""), F.array_join(F.transform(ps, part), " ")))

        parts = F.split(text, read["pattern"], -1)
        pairs = F.zip_with(parts, F.transform(read["found"], one), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
        return F.struct(F.when(F.size(read["found"]) > 0, F.array_join(pairs, "")).otherwise(text).alias("text"), F.size(read["found"]).alias("n"))

    plain = F.struct(text.alias("text"), F.lit(0).alias("n"))
    return F.when(F.regexp_like(text, F.lit(GATE)), _let(_read(text), put)).otherwise(plain)


def replace(docs: DataFrame, key: str = "verisift", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced; ``count_col`` names a column for their number.

    The default key is public: give one of your own where going back must be impossible.
    """
    few = materialize(exceptions(find(docs, text_col), key), "exceptions")
    own = "_pii"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    tried, row, new = f"{own}tried", f"{own}row", f"{own}new"
    text = F.col(f"`{text_col}`").cast("string")
    if few.isEmpty():
        out = docs.withColumn(tried, F.lit(None).cast("map<string,int>"))
    else:
        rows = docs.select(F.xxhash64(text).alias("row"), F.explode(_found(text)).alias("e")).select("row", "e.kind", "e.normal").distinct().join(few, ["kind", "normal"])
        maps = rows.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias(tried)).withColumnRenamed("row", row)
        out = docs.withColumn(row, F.xxhash64(text)).join(materialize(maps, "retries"), row, "left").drop(row)
    out = out.withColumn(new, _rewritten(text, F.col(tried), key)).withColumn(text_col, F.col(f"{new}.text"))
    if count_col:
        out = out.withColumn(count_col, F.col(f"{new}.n"))
    return out.drop(new, tried)
