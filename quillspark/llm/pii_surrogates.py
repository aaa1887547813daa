"""PII surrogates: entities in texts get keyed replacements of their own type and format, in DataFrame operations alone.

Types: e-mail, phone, IPv4, payment card, national id (ddd-dd-dddd), IBAN, and persons (title and name, or a listed given name
and a surname).  An entity's canonical form (case and separators removed) decides its surrogate,
so every mention of it changes alike, and each mention keeps its own format: digits go into the places of
digits, letters keep their case, separators stay.  Cards keep their checksum's validity, IBANs get valid check digits and keep
their country, cards their network's and phones their country code's first digit.  E-mails of one domain share a
surrogate domain.  Given names change to names of the same gender and script by a keyed
rotation of fixed lists (distinct by construction); surnames are built from syllables of their script.

Collision checks: candidates of all distinct entities of the corpus are compared by joins.  One that equals a real
entity, an earlier surrogate or a rival's candidate (the smallest canonical form wins) is drawn again under
the next attempt number, until none is left; later attempts get longer where the format allows it.  So distinct entities stay
distinct and no surrogate is someone else's data.

Only texts that hold entities are shuffled, keyed by a hash of the text, so copies share one entry; the
entity table is pre-aggregated, and a value in a third of the texts is one row.

Defined cases: null and empty texts stay as they are; null ids and repeated rows pass through; an empty table gives none;
other columns of ``docs`` stay: where one is called ``entities`` (in any case), the new column is ``entities_found``, with as
many underscores behind as make it new.  ``key`` is the secret; the same key gives the same surrogates for the same
corpus.  A format with fewer values than entities raises ValueError after ``MAX_ATTEMPTS`` draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._blocks import keep

MAX_ATTEMPTS = 40
LONGER_FROM = 6
TEXT, KEY, FOUND, MAP = "__qs_text", "__qs_key", "__qs_found", "__qs_map"

# Given names by script and gender, titles by gender, surname syllables by script.
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sophie Claire Marie Elena Lucia Carmen Ingrid Helga Susan Karen Alice".split(),
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Hans Klaus Pierre Jean Carlos Juan Miguel Luis".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña".split(),
          "m": "Mr Herr Monsieur Señor Sr Don".split(), "": "Dr Prof".split()}
SYLLABLES = {"latin": "bar ber bren cal cor dan del dor fal fer gar gren hal hol jen kar kel lan lor mar mel mor nor "
                      "pel ran ros sal sten tal tor val ven wil".split(),
             "cyrillic": "бар бел вол гор дан дор кар кол лан мар мир нов пав рос сав сем тар тор фед чер".split()}
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_TITLES = "|".join(t for titles in TITLES.values() for t in titles)
_PERSON = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLES})\.? (?:(?:{_NAMES}) )?\p{{Lu}}\p{{L}}+|(?:{_NAMES}) \p{{Lu}}\p{{L}}+)"
_GUARD, _UNTIL = r"(?<![A-Za-z0-9.+@_-])", r"(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    # as many labels as a domain name can have, and a bounded local part: neither recursion nor rescans grow with the text
    "email": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,256}+@(?:[A-Za-z0-9-]+\.){1,127}[A-Za-z]{2,}",
    "ip": rf"(?=[0-9]){_GUARD}(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])",
    "iban": rf"(?=[A-Z]{{2}}[0-9]){_GUARD}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_UNTIL}",
    "id": rf"(?=[0-9]){_GUARD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_UNTIL}",
    "phone": r"(?=\+)(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])"
             rf"|(?=[0-9(]){_GUARD}(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_UNTIL}",
    "card": rf"(?=[0-9]){_GUARD}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}){_UNTIL}",
    "person": _PERSON,
}
#: One pattern for all; the look-aheads reject most places by one character.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGITS = ("phone", "card", "id")


def _pair(hexa: Column, i: Column) -> Column:
    """Byte i of a 64-byte digest in hexadecimal (wrapping)."""
    return F.conv(F.substring(hexa, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 512)


def _same_classes(value: Column, hexa: Column, first: int = 0) -> Column:
    """Digits for digits, letters for letters of the same case, all else (and the first places) as it was."""
    def one(c, i):
        n = _pair(hexa, i)
        return F.when(i < first, c).when(c.between("0", "9"), F.pmod(n, F.lit(10)).cast("string")) \
            .when(c.between("a", "z"), F.char(n % 26 + 97)).when(c.between("A", "Z"), F.char(n % 26 + 65)).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when(
        (n - 1 - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """Value of an upper-case alphanumeric string (A = 10) modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _script(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")


def surrogate_form(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Candidate surrogate of a canonical form."""
    hexa = _digest(key, kind, canon, attempt)
    longer = F.when(attempt >= LONGER_FROM, F.substring(F.translate(hexa, "0123456789", "ghijklmnop"), F.lit(100),
                                                        attempt - LONGER_FROM + 2)).otherwise("")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    tail = F.regexp_extract(domain, r"\.[a-z]+$", 0)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tail))
    email = F.concat(_same_classes(local, hexa), longer, F.lit("@"),
                     _same_classes(host, _digest(key, F.lit("domain"), domain)), tail)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(
        i == 0, 1 + _pair(hexa, i) % 223).otherwise(1 + _pair(hexa, i) % 254).cast("string")), ".")
    draft = _same_classes(canon, hexa, 1)                  # a card keeps its network's first digit
    front = F.substring(draft, F.lit(1), F.length(draft) - 1)
    check = (10 - _luhn(F.concat(front, F.lit("0")))) % 10
    wanted = F.when(_luhn(canon) == 0, check).otherwise((check + 1 + _pair(hexa, F.lit(63)) % 9) % 10)
    card = F.concat(front, wanted.cast("string"))
    rest = F.substring(_same_classes(canon, hexa), F.lit(5), F.length(canon))
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest)
    phone = F.when(F.startswith(canon, F.lit("+")), _same_classes(canon, hexa, 2)).otherwise(_same_classes(canon, hexa))

    def built(script: str, least: int) -> Column:
        parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        size = F.lit(least) + F.when(attempt >= 2, attempt - 1).otherwise(0)
        return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at(
            parts, _pair(hexa, i) % len(SYLLABLES[script]) + 1)), "")
    surname = F.when(_script(canon) == "cyrillic", built("cyrillic", 3)).otherwise(built("latin", 3))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card) \
        .when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "surname", surname) \
        .otherwise(_same_classes(canon, hexa))


def entity_of(raw: Column) -> Column:
    """struct<kind, canon> of a mention."""
    kind = F.lit("person")
    for name in reversed([k for k in PATTERNS if k != "person"]):
        kind = F.when(F.regexp_like(raw, F.lit("^(?:" + PATTERNS[name] + ")$")), name).otherwise(kind)
    canon = F.when(kind == "email", F.lower(raw)).when(kind.isin("phone"), F.regexp_replace(raw, "[^0-9+]", "")) \
        .when(kind.isin("card", "id"), F.regexp_replace(raw, "[^0-9]", "")) \
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))) \
        .when(kind == "person", F.lower(F.substring_index(raw, " ", -1))).otherwise(raw)
    return F.struct(F.when(kind == "person", "surname").otherwise(kind).alias("kind"), canon.alias("canon"))


def _given(name: Column, key: str) -> Column:
    """Another given name of the same gender and script; ``name`` if it is in no list."""
    out = name
    for (script, gender), names in GIVEN.items():
        turn = F.pmod(F.conv(F.substring(_digest(key, F.lit(f"given {script} {gender}")), 1, 6), 16, 10).cast("int"),
                      F.lit(len(names) - 1)) + 1
        table = F.array(*[F.lit(n) for n in names])
        at = F.array_position(table, name).cast("int")
        out = F.when(at > 0, F.element_at(table, F.pmod(at - 1 + turn, F.lit(len(names))) + 1)).otherwise(out)
    return out


def render(raw: Column, kind: Column, surrogate: Column, key: str) -> Column:
    """The surrogate in the format of a mention."""
    chars = F.split(raw, "")
    digits = F.replace(surrogate, F.lit("+"), F.lit(""))
    filled = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lambda a, c: F.when(
        c.between("0", "9"), F.struct(F.concat(a["out"], F.substring(digits, a["k"], F.lit(1))).alias("out"),
                                      (a["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))))["out"]
    spaced = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), lambda a, c: F.when(
        c == " ", F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))).otherwise(
        F.struct(F.concat(a["out"], F.substring(surrogate, a["k"], F.lit(1))).alias("out"),
                 (a["k"] + 1).alias("k"))))["out"]
    cased = F.when(F.length(raw) != F.length(surrogate), surrogate).otherwise(F.array_join(F.transform(
        F.split(surrogate, ""), lambda c, i: F.when(F.element_at(chars, i + 1).between("A", "Z"), F.upper(c))
        .otherwise(c)), ""))
    last = F.substring_index(raw, " ", -1)
    name = F.when((F.length(last) > 1) & (last == F.upper(last)), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    before = F.substring(raw, F.lit(1), F.length(raw) - F.length(last))
    words = F.transform(F.split(F.rtrim(before), " "), lambda w: _given(w, key))
    person = F.concat(F.array_join(words, " "), F.lit(" "), name)
    return F.when(kind.isin(*_DIGITS), filled).when(kind == "iban", spaced).when(kind == "email", cased) \
        .when(kind == "surname", person).otherwise(surrogate)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): distinct surrogates of distinct entities, none of them a real entity."""
    real = entities.select("kind", F.col("canon").alias("form"))
    left, done, attempt = entities.select("kind", "canon"), None, 0
    while True:
        drawn = left.withColumn("form", surrogate_form(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        first = drawn.groupBy("kind", "form").agg(F.min("canon").alias("canon"))
        free = first.join(real, ["kind", "form"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "form"), ["kind", "form"], "left_anti")
        free = free.select("kind", "canon", "form")
        done = keep(free if done is None else done.unionByName(free))
        left = keep(left.join(done, ["kind", "canon"], "left_anti"))
        if left.limit(1).count() == 0:
            return done.withColumnRenamed("form", "surrogate")
        attempt += 1
        if attempt >= MAX_ATTEMPTS:
            raise ValueError("a format has fewer values than there are entities of it")


def may_hold(text: Column) -> Column:
    """A cheap test that every match of every pattern passes.

    E-mails have an @, addresses their dots, IBANs their country and check digits, phones a + or three digits, ids and
    cards three digits, persons a title or listed name.
    """
    return text.contains("@") | F.regexp_like(
        text, F.lit(r"[0-9]{3}|\+[0-9]|[0-9]\.[0-9]{1,3}\.[0-9]|[A-Z]{2}[0-9]{2}")) \
        | F.regexp_like(text, F.lit(rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLES}|{_NAMES})\.? "))


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = "quillspark") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and a new column ``entities`` (array<struct<kind, surrogate>>)."""
    text, taken, out = F.col(text_col), {c.lower() for c in docs.columns}, "entities"
    while out in taken:
        out = "entities_found" if out == "entities" else out + "_"
    base = docs.withColumn(FOUND, F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), 0)))
    found = F.size(F.coalesce(FOUND, F.array().cast("array<string>"))) > 0
    held = keep(base.filter(found).select(F.xxhash64(text).alias(KEY), F.explode(F.array_distinct(FOUND)).alias("raw"))
                .distinct().withColumn("e", entity_of(F.col("raw"))).select(KEY, "raw", "e.kind", "e.canon"))
    table = surrogate_table(keep(held.select("kind", "canon").distinct()), key)
    each = held.join(table, ["kind", "canon"]).select(KEY, F.struct(
        "raw", F.struct("kind", render(F.col("raw"), F.col("kind"), F.col("surrogate"), key).alias("form")).alias("to")
    ).alias("entry"))
    maps = each.groupBy(KEY).agg(F.map_from_entries(F.collect_list("entry")).alias(MAP))
    changed = base.filter(found).withColumn(KEY, F.xxhash64(text)).join(maps, KEY)
    pieces = F.split(text, ANY, -1)
    to = F.transform(FOUND, lambda m: F.element_at(F.col(MAP), m))
    new = F.concat(F.element_at(pieces, 1), F.array_join(F.zip_with(
        to, F.slice(pieces, F.lit(2), F.size(FOUND)), lambda t, p: F.concat(t["form"], p)), ""))
    kinds = F.transform(to, lambda t: F.struct(t["kind"].alias("kind"), t["form"].alias("surrogate")))
    changed = changed.withColumn(out, kinds).withColumn(text_col, new).select(*docs.columns, out)
    same = base.filter(~found).withColumn(out, F.array().cast("array<struct<kind:string,surrogate:string>>"))
    return changed.unionByName(same.select(*docs.columns, out))
