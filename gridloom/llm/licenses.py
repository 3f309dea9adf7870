"""License scans by ordered signature rules, in DataFrame functions alone.

A rule is a regex over normalised words with a keyword, a priority and a weight. RULES crosses licence
names with sentence templates (hundreds of rules). A document is first gated by cheap substring tests;
for gated documents a rule runs only if its keyword occurs. Detections are word intervals; one that lies
inside another, wider or earlier in priority, is suppressed (a sweep in order of start, wider first, then
priority). Everything is an expression on the row: no shuffle, no join, no Python on executors.

Defined cases: null or empty text has no words, null positions, empty labels and score 0; the phrases of
BASE always keep their labels; overlapping places of different rules that do not contain each other are
all kept.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

#: Phrases that always label a document.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that must occur as a word, regex of the names (over words divided by one space).
NAMES = (
    ("mit", "mit", "(?:mit|mit x11)"),
    ("mit", "expat", "expat"),
    ("mit-0", "mit", "mit (?:0|no attribution)"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version)? (?:v )?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)?"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "(?:zlib|zlib libpng)"),
    ("gpl-2", "gpl", "gpl ?v?(?:ersion )?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", "gpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "gnu", "gnu general public license(?: version)? v?2"),
    ("gpl-3", "gnu", "gnu general public license(?: version)? v?3"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl", "gnu", "gnu general public"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?(?:ersion )?2(?: 1| 0)?"),
    ("lgpl-3", "lgpl", "lgpl ?v?(?:ersion )?3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public"),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?v?(?:ersion )?3?(?: 0)?"),
    ("agpl-3", "affero", "(?:gnu )?affero general public"),
    ("mpl-2", "mozilla", "mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? v?1 1"),
    ("mpl-2", "mpl", "mpl ?v?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1", "eclipse", "eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl-1", "cddl", "cddl(?: 1(?: 0| 1)?)?"),
    ("boost-1", "boost", "boost software(?: license)?(?: version)?(?: 1(?: 0)?)?"),
    ("artistic-2", "artistic", "(?:perl )?artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: version)?(?: 1 1)?"),
    ("ofl-1.1", "sil", "sil open font"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "commons", "creative commons attribution(?: [1-4] 0)?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?"),
)
#: Sentence templates with their priority (lower first) and weight.
TEMPLATES = (
    ("spdx license identifier {}", 1, 1.0),
    ("licen[sc]ed under (?:the )?(?:terms of the )?{}(?: licen[sc]e)?", 2, 0.95),
    ("(?:released|distributed|available|provided|published|shared) under (?:the )?(?:terms of the )?{}(?: licen[sc]e)?", 3, 0.9),
    ("under (?:the )?(?:terms of the )?{} licen[sc]e", 4, 0.85),
    ("subject to (?:the )?(?:terms of the )?{}(?: licen[sc]e)?", 5, 0.8),
    ("licen[sc]e (?:is )?(?:the )?{}(?: licen[sc]e)?", 6, 0.7),
    ("{} licen[sc]e", 7, 0.6),
)
#: Label, keyword, regex, priority and weight of signatures of licence bodies, notices and headers.
BODIES = (
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied", 2, 0.9),
    ("mit", "granted", "to deal in the software without restriction", 2, 0.9),
    ("mit", "notice", "the above copyright notice and this permission notice shall be included in all copies", 2, 0.95),
    ("mit-0", "attribution", "mit no attribution", 1, 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 2, 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 2, 0.9),
    ("bsd-3", "endorse", "may (?:not )?be used to endorse or promote products derived from this software", 1, 0.9),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display", 1, 0.95),
    ("0bsd", "0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", 1, 0.9),
    ("isc", "negligence", "whether in an action of contract negligence or other tortious action", 4, 0.5),
    ("apache-2", "apache", "apache license version 2 0 january 2004", 1, 1.0),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 2, 0.9),
    ("apache-2", "governing", "see the license for the specific language governing permissions and limitations", 3, 0.8),
    ("apache-2", "apache", "www apache org licenses license 2 0", 2, 0.95),
    ("gpl-2", "gnu", "gnu general public license as published by the free software foundation(?: either)? version 2", 1, 1.0),
    ("gpl-3", "gnu", "gnu general public license as published by the free software foundation(?: either)? version 3", 1, 1.0),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public", 2, 0.9),
    ("gpl", "gnu", "www gnu org licenses gpl", 3, 0.8),
    ("gpl", "copyleft", "free copyleft license for software", 2, 0.8),
    ("lgpl-2.1", "lesser", "gnu lesser general public license version 2 1", 1, 1.0),
    ("lgpl-3", "lesser", "gnu lesser general public license version 3", 1, 1.0),
    ("lgpl", "lesser", "gnu lesser general public license as published by the free software foundation", 2, 0.9),
    ("lgpl", "gnu", "www gnu org licenses lgpl", 3, 0.8),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation", 1, 1.0),
    ("agpl-3", "gnu", "www gnu org licenses agpl", 3, 0.8),
    ("gfdl-1", "documentation", "gnu free documentation license(?: version 1(?: [1-3])?)?", 1, 0.95),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-2", "mozilla", "mozilla org mpl 2 0", 2, 0.9),
    ("mpl-1.1", "mpl", "subject to the mozilla public license version 1 1", 1, 1.0),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0", 1, 1.0),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license 2 0", 1, 1.0),
    ("cddl-1", "development", "common development and distribution license", 1, 0.95),
    ("cpl-1", "common", "common public license(?: version)?(?: v)? ?1 0", 1, 0.95),
    ("ipl-1", "ibm", "ibm public license(?: version)? 1 0", 1, 0.95),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: v| version)? ?1 2", 1, 0.95),
    ("eupl", "eupl", "eupl(?: v| version)? ?1(?: [0-2])?", 3, 0.8),
    ("osl-3", "osl", "(?:open software license|osl)(?: v| version)? ?3 0", 1, 0.9),
    ("afl-3", "academic", "academic free license(?: v| version)? ?3 0", 1, 0.9),
    ("artistic-1", "artistic", "the artistic license preamble", 1, 0.9),
    ("artistic-1", "perl", "under the same terms as perl itself", 2, 0.85),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1, 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 1, 0.95),
    ("libpng", "libpng", "libpng license(?: version)?(?: 2)?", 2, 0.9),
    ("boost-1", "boost", "boost software license version 1 0 august 17(?:th)? 2003", 1, 1.0),
    ("boost-1", "boost", "www boost org license 1 0 txt", 2, 0.95),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 1, 0.95),
    ("cc0-1", "cc0", "creative commons cc0(?: 1 0)?", 1, 0.95),
    ("cc0-1", "waived", "waived all copyright and related or neighboring rights", 1, 0.95),
    ("cc-by", "commons", "creative commons attribution 4 0 international", 1, 1.0),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike 4 0 international", 1, 1.0),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] 0", 1, 1.0),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] 0", 1, 1.0),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] 0", 1, 1.0),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] 0", 1, 1.0),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] 0", 1, 1.0),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] 0", 1, 1.0),
    ("cc0-1", "creativecommons", "creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("odbl-1", "database", "open (?:data commons open )?database license(?: v| version)?(?: ?1 0)?", 1, 0.95),
    ("odc-by-1", "commons", "open data commons attribution license", 1, 0.95),
    ("pddl-1", "dedication", "public domain dedication and license", 1, 0.95),
    ("python-2", "python", "python software foundation license(?: version 2)?", 1, 0.95),
    ("php-3", "php", "(?:the )?php license(?: version)? 3(?: 0[01]?)?", 1, 0.95),
    ("ruby", "ruby", "under the same (?:terms|license) as ruby", 2, 0.85),
    ("openssl", "openssl", "(?:dual )?openssl(?: and ssleay)? license", 1, 0.95),
    ("ofl-1.1", "font", "sil open font license(?: version)? 1 1", 1, 1.0),
    ("upl-1", "universal", "universal permissive license(?: v| version)?(?: ?1 0)?", 1, 0.95),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", 1, 1.0),
    ("postgresql", "postgresql", "(?:the )?postgresql licen[cs]e", 1, 0.95),
    ("bsl-1.1", "business", "business source license(?: 1 1)?", 1, 0.95),
    ("sspl-1", "server", "server side public license(?: v| version)?(?: ?1)?", 1, 0.95),
    ("elastic-2", "elastic", "elastic license(?: v| version)?(?: ?2(?: 0)?)?", 1, 0.95),
    ("commons-clause", "clause", "commons clause license condition", 1, 0.95),
    ("beerware", "beer", "you can buy me a beer in return", 1, 0.95),
    ("json", "evil", "the software shall be used for good not evil", 1, 0.95),
    ("ms-pl", "microsoft", "microsoft public license(?: ms pl)?", 1, 0.95),
    ("ms-rl", "microsoft", "microsoft reciprocal license(?: ms rl)?", 1, 0.95),
    ("proprietary", "proprietary", "proprietary and confidential", 8, 0.5),
    ("proprietary", "confidential", "unauthorized (?:copying|use|distribution) of this file (?:via any medium )?is strictly prohibited", 6, 0.6),
    ("non-commercial", "commercial", "for (?:personal and )?non ?commercial use only", 6, 0.6),
    ("research-only", "research", "for (?:academic|research)(?: and (?:academic|research))? (?:purposes|use) only", 6, 0.6),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1, 1.0),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1, 1.0),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", 4, 0.7),
    ("proprietary", "rights", "all rights reserved", 9, 0.3),
    ("apache-2", "apache", "apache license version 2(?: 0)?", 5, 0.9),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?", 5, 0.9),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?", 5, 0.9),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?", 5, 0.9),
)

#: Every rule's matches hold one of these, or all words of a pair whose regex the text has.
GATES = ("licen", "spdx", "software", "copyright", "commons", "permission", "redistribution", "tortious", "proprietary", "prohibited", "eupl")
WORD_GATES = (
    (("under",), "under"),
    (("subject",), "subject"),
    (("cc", "by", "nc"), "cc[^0-9a-z]+by"),
    (("cc0",), "cc0"),
    (("bsd",), "0?bsd"),
    (("public", "domain"), "domain"),
    (("rights", "reserved"), "reserved"),
    (("altered", "source"), "altered"),
    (("beer", "return"), "beer"),
    (("attribution",), "attribution"),
    (("mozilla",), "mozilla"),
    (("only", "use"), "use[^0-9a-z]+only"),
    (("only", "purposes"), "purposes[^0-9a-z]+only"),
)

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regex over words, priority, weight), in priority order."""
    crossed = [(label, word, t.format(f"(?:{name})"), p, w) for t, p, w in TEMPLATES for label, word, name in NAMES]
    return sorted([*crossed, *BODIES], key=lambda r: r[3])


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def numbered(rx: str) -> str:
    """A rule's regex over words that carry their number (word#12), one space on both sides of each."""
    rx = rx.replace(" ?", "(?:#[0-9]+ )?").replace(" ", "#[0-9]+ ").replace("(?:#[0-9]+#[0-9]+ )?", "(?:#[0-9]+ )?")
    return f"(?<= )(?:{rx})#[0-9]+(?= )"


def swept(ordered: Column) -> Column:
    """Detections in order of start, wider first, then priority, without those that end no later than one before.

    The array is cut into pieces of about the root of its size: each piece needs only the latest end before it.
    """
    piece = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(ordered)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / piece).cast("int")), lambda k: F.slice(ordered, k * piece + 1, piece))
    tops = F.transform(pieces, lambda x: F.array_max(F.transform(x, lambda d: -d.getField("back"))))
    before = F.aggregate(tops, F.array(F.lit(-1)), lambda acc, t: F.concat(acc, F.array(F.greatest(t, F.element_at(acc, -1)))))
    none = F.expr("cast(array() as array<struct<first:int,after:int,label:string,weight:double>>)")
    kept = lambda d: F.array(F.struct(d.getField("s").alias("first"), (-d.getField("back")).alias("after"), d.getField("label").alias("label"), d.getField("w").alias("weight")))
    step = lambda acc, d: F.when(-d.getField("back") > acc.getField("end"), F.struct((-d.getField("back")).alias("end"), F.concat(acc.getField("kept"), kept(d)).alias("kept"))).otherwise(acc)
    both = F.arrays_zip(pieces.alias("x"), F.slice(before, F.lit(1), F.size(pieces)).alias("end"))  # what a lambda names is evaluated anew for each element
    sweep = lambda z: F.aggregate(z.getField("x"), F.struct(z.getField("end").alias("end"), none.alias("kept")), step, lambda acc: acc.getField("kept"))
    return F.flatten(F.transform(both, sweep))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and detections to each row.

    detections: (first word, word after the last, label, weight) of what suppression left. Columns of df
    with these names are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(raw)
    word = lambda rx: F.col("__low").rlike(f"(?<![0-9a-z])(?:{rx})(?![0-9a-z])")
    has = lambda *parts: reduce(and_, [F.contains(F.col("__low"), F.lit(x)) for x in parts])
    gate = reduce(or_, [has(x) for x in GATES]) | reduce(or_, [reduce(and_, [has(x) for x in some]) & word(rx) for some, rx in WORD_GATES])
    vocabulary = sorted({r[1] for r in rules()})
    # normalised words, with one space on both sides of each; null where the gate is shut
    normal = F.when(gate, F.concat(F.lit(" "), F.regexp_replace(F.translate(F.concat(raw, F.lit(" ")), _UPPER, _UPPER.lower()), _NOT_WORD, " ")))
    normal = F.regexp_replace(normal, "^ +", " ")
    base = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    of_word = {w: F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f"(?<= )(?:{rx})(?= )").alias("plain"), F.lit(numbered(rx)).alias("rx"), F.lit(p).alias("p"), F.lit(weight).alias("w")) for label, word_, rx, p, weight in rules() if word_ == w]) for w in vocabulary}
    rule_map = F.create_map(*[x for w in vocabulary for x in (F.lit(w), of_word[w])])
    any_of = {w: "(?<= )(?:" + "|".join(rx for _, word_, rx, *_ in rules() if word_ == w) + ")(?= )" for w in vocabulary}
    any_map = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, any_of[w])])
    n = F.col("__n")
    # the same with each word's number, so that what a rule matches tells its place
    places = F.transform(F.split(F.trim(n), " "), lambda w, i: F.concat(w, F.lit("#"), i.cast("string")))
    there = F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(n, F.concat(F.lit(" "), w, F.lit(" "))))
    # a keyword's rules are tried one by one only where one of them matches
    candidates = F.flatten(F.transform(F.filter(there, lambda w: F.regexp_like(n, any_map[w])), lambda w: rule_map[w]))
    candidates = F.filter(candidates, lambda r: F.regexp_like(n, r.getField("plain")))
    number = lambda m, rx: F.regexp_extract(m, rx, 1).cast("int")
    hits = F.transform(
        F.col("__c"),
        lambda r: F.transform(
            F.regexp_extract_all(F.col("__p"), r.getField("rx"), F.lit(0)),
            lambda m: F.struct(number(m, "#([0-9]+)").alias("s"), (-1 - number(m, "#([0-9]+)$")).alias("back"), r.getField("p").alias("p"), r.getField("label").alias("label"), r.getField("w").alias("w")),
        ),
    )
    none = F.expr("cast(array() as array<struct<first:int,after:int,label:string,weight:double>>)")
    labels_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")

    df = df.drop("__low", "__n", "__c", "__p", "__o", "__m", "__s", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    df = df.withColumn("__low", low).withColumn("__n", normal).drop("__low")
    df = df.withColumn("__c", F.when(n.isNotNull(), candidates))
    df = df.withColumn("__p", F.when(F.size("__c") > 0, F.concat(F.lit(" "), F.array_join(places, " "), F.lit(" "))))
    df = df.withColumn("__o", F.when(F.size("__c") > 0, F.array_sort(F.flatten(hits))))
    df = df.withColumns({
        "n_words": F.regexp_count(raw, F.lit(_WORDS)).cast("long"),
        "__m": F.when(F.col("__n").rlike(base), F.regexp_extract_all(n, F.lit(base), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")),
        "__s": F.when(F.col("__n").rlike(base), F.split(n, base, -1)),
        "detections": F.when(F.size("__o") > 0, swept(F.col("__o"))).otherwise(none),
    })
    name = F.create_map(*[F.lit(x) for pair in BASE for x in pair])
    own = F.transform(F.col("__m"), lambda x: name[x])
    some = F.size("__m") > 0
    return df.withColumns({
        "n_base": F.size("__m").cast("long"),
        "first_word": F.when(some, _spaces(F.get("__s", F.lit(0))) - 1).cast("long"),
        "last_word": F.when(some, F.col("n_words") - (_spaces(F.element_at("__s", -1)) - 1) - (_spaces(F.element_at("__m", -1)) + 1)).cast("long"),
        "base_labels": labels_of(own),
        "labels": labels_of(F.concat(own, F.col("detections.label"))),
        "score": F.when(some, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("detections.weight")), F.lit(0.0))),
    }).drop("__n", "__c", "__p", "__o", "__m", "__s")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every whole text of documents."""
    prepare(spark)
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))
