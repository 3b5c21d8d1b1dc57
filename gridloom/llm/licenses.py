"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes a line of words: ASCII letters lower-cased, words separated by
one space.  Every rule has keywords (each of its matches holds one of them as a
whole word), a regular expression over the line, a priority and a label.  Only
rules of which a keyword occurs in the text run.  Their matches are word intervals; a match is
suppressed when a match of the same or a better priority contains its interval.
Base phrases are rules as well: they always count, suppressed or not.

Defined results: a null or empty text has no words, no labels and score 0; rows
that repeat (same id, same text) give the same result row each; rows of one id
with different texts stay apart; a null id is kept; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import table, without

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: priorities: exact tags, grants with a version, names, general notices
TAG, GRANT, NAME, NOTICE = range(4)


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str
    confidence: float
    base: bool = False
    #: words that a match may hold in place of the keyword: "gplv3" for "gpl"
    glued: tuple[str, ...] = ()

    @property
    def keywords(self) -> tuple[str, ...]:
        return (self.keyword, *self.glued)

    @property
    def regex(self) -> str:
        """Words are led by a space each; the line ends with one."""
        return f" {self.pattern}(?= )"


#: fixed values of the contract: phrase, keyword and label of the base rules
BASE = [("cc by", "cc", "cc-by"), ("general public license", "license", "gpl"), ("all rights reserved", "reserved", "reserved")]

#: label stem, spoken name, short name, versions ("" for none)
FAMILIES = [
    ("apache", "apache", "apache", "1.0 1.1 2.0"),
    ("gpl", "(?:gnu )?general public", "gpl", "1 2 3"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "lgpl", "2 2.1 3"),
    ("agpl", "(?:gnu )?affero general public", "agpl", "1 3"),
    ("gfdl", "(?:gnu )?free documentation", "gfdl", "1.1 1.2 1.3"),
    ("mpl", "mozilla public", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public", "epl", "1.0 2.0"),
    ("eupl", "european union public", "eupl", "1.0 1.1 1.2"),
    ("cddl", "common development and distribution", "cddl", "1.0 1.1"),
    ("cpl", "common public", "cpl", "1.0"),
    ("osl", "open software", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic", "1.0 2.0"),
    ("ofl", "(?:sil )?open font", "ofl", "1.0 1.1"),
    ("bsl", "boost software", "bsl", "1.0"),
    ("zpl", "zope public", "zpl", "1.1 2.0 2.1"),
    ("php", "php", "php", "3.0 3.01"),
    ("psf", "python software foundation", "psf", "2.0"),
    ("qpl", "q public", "qpl", "1.0"),
    ("ms-pl", "microsoft public", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal", "ms rl", ""),
    ("odbl", "open database", "odbl", "1.0"),
    ("odc-by", "open data commons attribution", "odc by", "1.0"),
    ("pddl", "public domain dedication and", "pddl", "1.0"),
    ("mit", "mit", "mit", ""),
    ("isc", "isc", "isc", ""),
    ("zlib", "zlib(?: libpng)?", "zlib", ""),
    ("wtfpl", "do what the fuck you want to public", "wtfpl", ""),
    ("unlicense", "unlicense", "unlicense", ""),
    ("ncsa", "(?:university of illinois )?ncsa open source", "ncsa", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("upl", "universal permissive", "upl", "1.0"),
]
CLAUSES = {"0": "zero", "2": "two", "3": "three", "4": "four"}
CC_PARTS = {"by": "attribution", "sa": "sharealike|share alike", "nc": "noncommercial|non commercial", "nd": "noderivatives|noderivs|no derivatives|no derivs"}
CC_KINDS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def _words(x: str) -> str:
    return re.sub(r"[.\-]", " ", x)


def _glued(short: str, version: str) -> tuple[str, ...]:
    """First words of a short name's matches that are longer than the name: it runs into "version" or the number."""
    if " " in short:
        return ()
    signs = ["", "v", "ver", "version"]
    return tuple(sorted({short + s + v for s in signs for v in ("", version.split()[0], "v" + version.split()[0])} - {short}))


def rules() -> list[Rule]:
    """All rules in order: base phrases, families in several wordings, notices."""
    out = [Rule(NOTICE, label, key, phrase, 0.6, base=True) for phrase, key, label in BASE]
    for stem, name, short, versions in FAMILIES:
        words = [(f"{stem}-{v}", _words(v)) for v in versions.split()]
        for label, v in words:
            num = rf"(?:v|ver|version)? ?v?{v}" if " " in v else rf"(?:v|ver|version)? ?v?{v}(?: 0)?"
            out += [
                Rule(TAG, label, "spdx", rf"spdx license identifier {_words(stem)} {v}(?: 0)?(?: only| or later)?", 1.0),
                Rule(GRANT, label, "license", rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name} license {num}(?: only| or later)?", 0.95),
                Rule(GRANT, label, "license", rf"{name} license {num}", 0.9),
                Rule(GRANT, label, short.split()[0], rf"{short} ?{num}", 0.8, glued=_glued(short, v)),
            ]
        out += [
            Rule(TAG, stem, "spdx", rf"spdx license identifier {_words(stem)}", 0.9),
            Rule(NAME, stem, "license", rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name} license", 0.85),
            Rule(NAME, stem, "license", rf"{name} license", 0.75),
            Rule(NAME, stem, "licence", rf"{name} licence", 0.75),
        ]
    for digit, word in CLAUSES.items():
        out += [
            Rule(TAG, f"bsd-{digit}-clause", "spdx", rf"spdx license identifier bsd {digit} clause", 1.0),
            Rule(GRANT, f"bsd-{digit}-clause", "bsd", rf"bsd (?:{digit}|{word}) clause(?: license)?", 0.9),
            Rule(GRANT, f"bsd-{digit}-clause", "bsd", rf"(?:{digit}|{word}) clause bsd(?: license)?", 0.9),
        ]
    out.append(Rule(NAME, "bsd", "bsd", r"(?:new |simplified |modified |original )?bsd (?:style )?licen[sc]e", 0.75))
    for kind in CC_KINDS:
        spoken = " ".join(f"(?:{CC_PARTS[p]})" for p in kind.split("-"))
        for v in CC_VERSIONS:
            out += [
                Rule(TAG, f"cc-{kind}-{v}", "cc", rf"(?:spdx license identifier )?cc {_words(kind)} {_words(v)}", 1.0),
                Rule(GRANT, f"cc-{kind}-{v}", "commons", rf"creative commons {spoken} {_words(v)}(?: international| unported| generic)?(?: license)?", 0.95),
            ]
        out += [Rule(NAME, f"cc-{kind}", "cc", rf"cc {_words(kind)}", 0.75), Rule(NAME, f"cc-{kind}", "commons", rf"creative commons {spoken}", 0.8)]
    out += [
        Rule(GRANT, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
        Rule(GRANT, "mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
        Rule(GRANT, "isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
        Rule(GRANT, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
        Rule(GRANT, "zlib", "altered", r"altered source versions must be plainly marked as such", 0.9),
        Rule(GRANT, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
        Rule(NAME, "public-domain", "domain", r"(?:in|into|to) the public domain", 0.7),
        Rule(NOTICE, "copyright", "copyright", r"copyright(?: c)?(?: [0-9]{4})+", 0.5),
        Rule(NOTICE, "proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.5),
        Rule(NOTICE, "license", "license", r"(?:licensed|released|distributed) under(?: [^ ]+){1,4}? license", 0.4),
    ]
    return out


def _literal_rules(found: list[Rule]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.regex).alias("regex"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base"))
            for r in found
        ]
    )


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _intervals(line: Column, rule: Column) -> Column:
    """Word intervals [start, end) of every match of a rule in the line."""
    gaps = F.split(line, rule["regex"], -1)
    hits = F.regexp_extract_all(line, rule["regex"], F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    counted = F.transform(F.filter(pairs, lambda p: p["hit"].isNotNull()), lambda p: F.struct(_spaces(p["gap"]).alias("gap"), _spaces(p["hit"]).alias("n")))
    # words before match k: the gaps up to k and the matches before k
    sums = F.aggregate(
        counted,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct((acc["at"] + p["gap"] + p["n"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + p["gap"])).alias("starts")),
    )
    return F.transform(
        F.arrays_zip(sums["starts"].alias("start"), F.transform(counted, lambda p: p["n"]).alias("n")),
        lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + m["n"]).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")
        ),
    )


def scan(docs: DataFrame, signature: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match or, for a text without any, one row without match.

    ``id, key, n_words, pos, start, end, priority, label, confidence, base,
    kept``; ``key`` tells texts of one id apart and ``pos`` is null or counts
    the matches of a text from 0.
    """
    found = signature or rules()
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() may change non-ASCII letters too; that moves no word border and can only let more texts through the gate
    words = F.array_remove(F.split(F.lower(text), SEPARATORS), "")
    gates = F.array(*[F.lit(k) for k in sorted({k for r in found for k in r.keywords})])
    gated = without(docs, id_col, text_col).toDF("id", "text").select("id", "text", words.alias("words"))
    gated = gated.select("id", F.xxhash64(text).alias("key"), F.size("words").cast("bigint").alias("n_words"), F.array_intersect("words", gates).alias("keys"), text.alias("text"))
    upper = "".join(map(chr, range(65, 91)))
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", upper, upper.lower()), SEPARATORS, " ")), F.lit(" "))
    gated = gated.select("id", "key", "n_words", "keys", F.when(F.size("keys") > 0, line).alias("line"))
    active = F.filter(_literal_rules(found), lambda r: F.arrays_overlap(F.col("keys"), r["keywords"]))
    matches = F.when(F.col("line").isNotNull(), F.flatten(F.transform(active, lambda r: _intervals(F.col("line"), r))))
    rows = gated.select("id", "key", "n_words", F.posexplode_outer(matches).alias("pos", "m")).select("id", "key", "n_words", "pos", "m.*")
    order = Window.partitionBy("id", "key").orderBy("start", F.desc("end"), "priority", "label", "pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order) for p in range(NOTICE + 1)]
    better = F.coalesce(*[F.when(F.col("priority") == p, reach[p]) for p in range(NOTICE + 1)])
    return rows.withColumn("kept", F.col("pos").isNotNull() & ~F.coalesce(better >= F.col("end"), F.lit(False)))


def summary(matches: DataFrame) -> DataFrame:
    """One row per input row of ``scan``: counts, places, labels and score."""
    copies = F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1))
    is_base = F.coalesce(F.col("base"), F.lit(False))
    grouped = matches.groupBy("id", "key", "n_words").agg(
        copies.alias("copies"),
        F.count(F.when(is_base, 1)).alias("base_rows"),
        F.min(F.when(is_base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept") | is_base, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept") | is_base, F.col("confidence"))), F.lit(0.0)).alias("score"),
    )
    return grouped.select(
        F.col("id").alias("doc_id"), "n_words", F.expr("base_rows div copies").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    ).drop("copy")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(table(spark, sf_dir, "documents")))
