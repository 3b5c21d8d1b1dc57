"""Personal data and secrets: keyed, consistent surrogates, in DataFrame functions only.

One regular expression finds the entities; the rest of a text is kept as it is.
An entity falls into parts that have a surrogate each: an address into mailbox
and domain, a person into given names and surname (the title stays), all others
are one part.  A part's canonical form (lower case, digits without separators)
and a secret key give its surrogate, so the same part gets the same surrogate
everywhere, however it is written, and a surname keeps it with or without a
title.  Capitalised words that equal a given name or surname found elsewhere in
the same text are mentions of it and get its surrogate.  Letters become letters of the same script and case, digits digits, card
numbers keep being valid or invalid, network addresses stay addresses, given
names keep their gender.

Collisions are checked over the whole table: no two parts of a type may share a
surrogate, and no surrogate may be a part that occurs.  Those that fail are
derived again with the next attempt number until none fails.

Defined results: a null text stays null, an empty one empty; rows that repeat
an id and its text give equal rows; a null id is kept; all further columns of
the input are kept as they are, whatever they are called; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, table, without, written

WORDISH = r"\p{L}\p{N}._%+\-"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: fixed values: titles by gender, and given names that are taken for a person before a capitalised word
TITLES = {"m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Signor|господин|г-н", "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Signora|госпожа|г-жа", "u": "Dr|Prof|Mx"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Hans Peter Stefan Jürgen Klaus Pierre Jean Michel Philippe Antoine José Juan Carlos Luis Miguel Иван Пётр Сергей Алексей Дмитрий",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula Monika Sabine Petra Marie Nathalie Isabelle Sylvie Céline María Carmen Ana Isabel Lucía Мария Анна Елена Ольга Татьяна",
}
NAME = rf"\p{{Lu}}[\p{{L}}'’\-]++(?![{WORDISH}]*@)"
_ALL_TITLES = "|".join(TITLES.values())
_ALL_GIVEN = "|".join(" ".join(GIVEN.values()).split())
_TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:{_ALL_TITLES})\.? (?:{NAME} ){{0,2}}{NAME}"
_NAMED = rf"(?<![\p{{L}}\p{{N}}])(?:{_ALL_GIVEN}) {NAME}"
#: in order of preference
PATTERNS = {
    "email": rf"(?<![{WORDISH}])[{WORDISH}]++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "person": f"{_TITLED}|{_NAMED}",
}
ANY = "|".join(PATTERNS.values())
GATE = f"[0-9@]|{PATTERNS['person']}"
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
PART = "array<struct<kind: string, canon: string, raw: string>>"


def _piece(kind: str | Column | None, canon: Column | None, raw: Column) -> Column:
    kind = F.lit(kind) if kind is None or isinstance(kind, str) else kind
    return F.struct(kind.cast("string").alias("kind"), (F.lit(None) if canon is None else canon).cast("string").alias("canon"), raw.alias("raw"))


def _kind(entity: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _person_parts(x: Column) -> Column:
    """Title and spaces stay; the last name is the surname, those before are given names."""
    title = F.regexp_extract(x, rf"^(?:(?:{_ALL_TITLES})\.? )?", 0)
    gender = F.lit("u")
    for g in ("m", "f"):
        names = "|".join(GIVEN[g].split())
        gender = F.when(title.rlike(rf"^(?:{TITLES[g]})\.? $") | ((title == "") & x.rlike(rf"^(?:{names}) ")), F.lit(g)).otherwise(gender)
    names = F.split(F.substring(x, F.length(title) + 1, F.length(x)), " ")
    stem = lambda n: F.regexp_replace(n, "['’]s$", "")
    parts = F.transform(
        names,
        lambda n, i: F.array(
            _piece(F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)), F.lower(stem(n)), stem(n)),
            _piece(None, None, F.concat(F.substring(n, F.length(stem(n)) + 1, F.length(n)), F.when(i == F.size(names) - 1, F.lit("")).otherwise(F.lit(" ")))),
        ),
    )
    return F.concat(F.array(_piece(None, None, title)), F.flatten(parts))


def _parts(entity: Column) -> Column:
    kind = _kind(entity)
    box, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.array(_piece("mailbox", F.lower(entity), box), _piece(None, None, F.lit("@")), _piece("domain", F.lower(domain), domain))
    canon = F.when(kind.isin("card", "ssn", "phone"), _digits(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(F.lower(entity))
    return F.when(kind == "email", email).when(kind == "person", _person_parts(entity)).otherwise(F.array(_piece(kind, canon, entity)))


def _sequence(text: Column) -> Column:
    """The text as parts in order; stretches between entities have no kind."""
    gaps = F.split(text, ANY, -1)
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.flatten(
        F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: F.concat(F.array(_piece(None, None, p["gap"])), F.when(p["hit"].isNotNull(), _parts(p["hit"])).otherwise(F.array().cast(PART))))
    )


def _with_mentions(texts: DataFrame) -> DataFrame:
    """``parts`` with the capitalised words between entities that equal a name found in the same text."""
    named = F.filter("parts", lambda p: (p["kind"] == "surname") | p["kind"].startswith("given_"))
    texts = texts.withColumn("names", F.array_distinct(F.transform(named, lambda p: F.struct(p["canon"].alias("canon"), p["kind"].alias("kind")))))
    # longer names first; names hold letters, apostrophes and hyphens only
    ordered = F.reverse(F.array_sort(F.transform("names", lambda n: F.struct(F.length(n["canon"]).alias("size"), n["canon"].alias("canon")))))
    any_name = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(F.transform(ordered, lambda n: n["canon"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    texts = texts.withColumn("any_name", any_name)

    def mention(word: Column) -> Column:
        return _piece(F.filter("names", lambda n: n["canon"] == F.lower(word))[0]["kind"], F.lower(word), word)

    def opened(p: Column) -> Column:
        pairs = F.arrays_zip(F.split(p["raw"], F.col("any_name"), -1).alias("gap"), F.regexp_extract_all(p["raw"], F.col("any_name"), F.lit(0)).alias("hit"))
        inside = F.transform(pairs, lambda x: F.concat(F.array(_piece(None, None, x["gap"])), F.when(x["hit"].isNotNull(), F.array(mention(x["hit"]))).otherwise(F.array().cast(PART))))
        return F.when(p["kind"].isNull(), F.flatten(inside)).otherwise(F.array(p))

    both = F.when(F.size("names") > 0, F.flatten(F.transform("parts", opened))).otherwise(F.col("parts"))
    return texts.withColumn("parts", both).drop("names", "any_name")


def _number(hexes: Column, i: Column) -> Column:
    """A number from 0 to 65535 out of 128 hex digits."""
    return F.conv(F.substring(hexes, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _scrambled(canon: Column, hexes: Column, hexadecimal: bool = False) -> Column:
    """Same length and script: digits for digits, letters for letters, the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(hexes, i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter(CYRILLIC, n))
            .when(c.rlike(r"\p{IsGreek}"), _letter(GREEK, n))
            .when(c.rlike(r"\p{L}"), _letter(LATIN[:6] if hexadecimal else LATIN, n))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(canon), one), "")


def _luhn_sum(digits: Column) -> Column:
    doubled = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(canon: Column, hexes: Column) -> Column:
    body = F.substring(_scrambled(canon, hexes), F.lit(1), F.length(canon) - 1)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.concat(body, F.when(_luhn_sum(canon) % 10 == 0, check).otherwise((check + 1) % 10).cast("string"))


def _address(hexes: Column) -> Column:
    return F.concat_ws(".", (_number(hexes, F.lit(0)) % 223 + 1).cast("string"), *[(_number(hexes, F.lit(i)) % 256).cast("string") for i in (1, 2, 3)])


def _given(gender: str, canon: Column, hexes: Column, attempt: Column) -> Column:
    """A name of the gender and script; later attempts join several with hyphens."""
    script = r"\p{IsCyrillic}"
    names = [n.lower() for g in (GIVEN if gender == "u" else [gender]) for n in GIVEN[g].split()]
    cyrillic = [n for n in names if any(c in CYRILLIC for c in n)]
    pools = [F.array(*map(F.lit, p)) for p in (cyrillic, [n for n in names if n not in cyrillic])]
    pick = lambda pool: F.array_join(F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(30))), lambda i: F.element_at(pool, _number(hexes, i) % F.size(pool) + 1)), "-")
    return F.when(canon.rlike(script), pick(pools[0])).otherwise(pick(pools[1]))


def _surrogate(secret: str) -> Column:
    """Of columns ``kind``, ``canon`` and ``attempt``."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    inner = F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, canon, attempt.cast("string")), 512)
    hexes = F.sha2(F.concat(F.lit(secret), inner), 512)
    # a short part has few surrogates of its length: every further try may be one sign longer
    grown = F.concat(canon, F.when(kind.isin("mailbox", "domain", "surname"), F.repeat(F.lit("a"), attempt)).otherwise(F.lit("")))
    box = F.regexp_extract(canon, "^[^@]*", 0)
    mailbox = F.concat(box, F.repeat(F.lit("a"), attempt))
    land = F.greatest(F.length(canon) - 10, F.lit(0))  # the country code stays
    top = F.concat(F.lit("."), F.substring_index(canon, ".", -1))
    domain = F.substring(canon, F.lit(1), F.length(canon) - F.length(top))
    return (
        F.when(kind == "mailbox", _scrambled(mailbox, hexes))
        .when(kind == "domain", F.concat(_scrambled(F.concat(domain, F.repeat(F.lit("a"), attempt)), hexes), top))
        .when(kind == "secret", _scrambled(canon, hexes, hexadecimal=True))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _scrambled(F.lower(F.substring(canon, F.lit(3), F.length(canon))), hexes)))
        .when(kind == "ip", _address(hexes))
        .when(kind == "card", _card(canon, hexes))
        .when(kind == "phone", F.concat(F.substring(canon, F.lit(1), land), _scrambled(F.substring(canon, land + 1, F.length(canon)), hexes)))
        .when(kind == "given_m", _given("m", canon, hexes, attempt))
        .when(kind == "given_f", _given("f", canon, hexes, attempt))
        .when(kind == "given_u", _given("u", canon, hexes, attempt))
        .otherwise(_scrambled(grown, hexes))
    )


def surrogates(parts: DataFrame, secret: str, max_attempts: int = 60) -> DataFrame:
    """``kind, canon, surrogate`` for the distinct parts ``kind, canon``, without collisions."""
    own = F.when(F.col("kind") == "mailbox", F.substring_index("canon", "@", 1)).otherwise(F.col("canon"))
    # mailboxes collide within a domain only, but the simple rule keeps them apart everywhere
    todo = written(parts.select("kind", "canon").distinct()).withColumn("attempt", F.lit(0))
    real = todo.select("kind", own.alias("surrogate")).distinct().withColumn("is_real", F.lit(True))
    done = None
    for _ in range(max_attempts):
        tried = written(todo.withColumn("surrogate", _surrogate(secret)))
        first = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("first"))
        checked = tried.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        if done is not None:
            checked = checked.join(done.select("kind", "surrogate", F.lit(True).alias("taken")), ["kind", "surrogate"], "left")
        else:
            checked = checked.withColumn("taken", F.lit(None).cast("boolean"))
        good = (F.col("canon") == F.col("first")) & F.col("is_real").isNull() & F.col("taken").isNull()
        checked = written(checked.select("kind", "canon", "surrogate", "attempt", good.alias("good")))
        fine = checked.filter("good").select("kind", "canon", "surrogate")
        done = fine if done is None else done.unionAll(fine)
        todo = checked.filter("NOT good").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done
    raise RuntimeError("no collision-free surrogates: raise max_attempts")


def _rendered(part: Column, surrogate: Column) -> Column:
    """The surrogate in the raw part's way of writing: separators, and upper case where it has it."""
    raw = part["raw"]
    separated = F.array_join(
        F.transform(_chars(raw), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, F.length(_digits(F.substring(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""
    )
    spaced = F.array_join(
        F.transform(_chars(raw), lambda c, i: F.when(c == " ", c).otherwise(F.upper(F.substring(surrogate, F.length(F.replace(F.substring(raw, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))))), ""
    )
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1), F.upper(surrogate)).when(
        F.substring(raw, 1, 1) != F.lower(F.substring(raw, 1, 1)), F.when(part["kind"].startswith("given"), F.initcap(F.replace(surrogate, F.lit("-"), F.lit(" ")))).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    )
    cased = F.coalesce(F.when(part["kind"].startswith("given"), F.replace(cased, F.lit(" "), F.lit("-"))).otherwise(cased), surrogate)
    return F.when(part["kind"].isNull(), raw).when(part["kind"].isin("card", "ssn", "phone"), separated).when(part["kind"] == "iban", spaced).otherwise(cased)


def replace_pii(docs: DataFrame, secret: str = "gridloom", text_col: str = "text") -> tuple[DataFrame, Column]:
    """The input with its text replaced, and its extra column: kind and surrogate of every part replaced."""
    mark = fresh(docs, "_pii")
    one, two, new_text, entities = (f"{mark}_{x}" for x in ("one", "two", "text", "entities"))
    empty = F.array().cast("array<struct<kind: string, surrogate: string>>")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col(f"`{text_col}`")
    gated = F.coalesce(text.rlike(GATE) & text.rlike(ANY), F.lit(False))
    plain = docs.filter(~gated).select(*columns, empty.alias(entities))
    hit = docs.filter(gated).select(*columns, F.xxhash64(text).alias(one), F.xxhash64(text, F.lit(1)).alias(two))
    # texts, not rows, are worked on: copies share one result
    texts = hit.select(F.col(one).alias("one"), F.col(two).alias("two"), text.alias("text")).dropDuplicates(["one", "two"])
    texts = written(_with_mentions(texts.select("one", "two", _sequence(F.col("text")).alias("parts"))))
    flat = texts.select("one", "two", F.posexplode("parts").alias("at", "part")).select("one", "two", "at", "part.*").filter("kind IS NOT NULL")
    found = flat.join(surrogates(flat, secret), ["kind", "canon"]).groupBy("one", "two").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("new"))
    shown = F.transform("parts", lambda p, i: F.struct(p["kind"].alias("kind"), _rendered(p, F.element_at("new", i)).alias("surrogate")))
    done = texts.join(found, ["one", "two"], "left").select("one", "two", shown.alias("shown"))
    done = done.select(
        F.col("one").alias(one),
        F.col("two").alias(two),
        F.array_join(F.transform("shown", lambda s: s["surrogate"]), "").alias(new_text),
        F.filter("shown", lambda s: s["kind"].isNotNull()).alias(entities),
    )
    back = hit.drop(text_col).join(done, [one, two]).select(*[F.col(new_text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], entities)
    return plain.unionAll(back), F.col(entities)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean, entities = replace_pii(without(table(spark, sf_dir, "documents"), "doc_id", "text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["kind"]))), ",")
    return clean.select("doc_id", "text", F.size(entities).cast("bigint").alias("n_entities"), kinds.alias("kinds"))
