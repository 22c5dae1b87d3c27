"""License scans: ordered signature rules, gated by keywords, with overlapping detections resolved. DataFrame functions only.

A text is folded to lower case and its words joined by single spaces, so that rules need not know of punctuation or line
ends. Rules are (keyword, pattern, label, priority, confidence); a pattern is tried only where its keyword occurs. A
detection lying wholly inside another is dropped if that other is longer or, for the same interval, of smaller priority.
No row is shuffled: everything happens inside a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed by the contract: phrases of whole words and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: name -> (keyword that any form has, forms in words, versions). Words are lower case, without punctuation.
FAMILIES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "gpl": ("gnu general public", ("gnu general public license",), ("1", "2", "3")),
    "gpl-short": ("gpl", ("gpl", "gnu gpl", "gplv"), ("1", "2", "3")),
    "lgpl": ("general public license", ("gnu lesser general public license", "gnu library general public license"), ("2", "2 1", "3")),
    "lgpl-short": ("lgpl", ("lgpl", "gnu lgpl"), ("2", "2 1", "3")),
    "agpl": ("gnu affero general public", ("gnu affero general public license",), ("1", "3")),
    "agpl-short": ("agpl", ("agpl", "gnu agpl"), ("1", "3")),
    "gfdl": ("gnu free documentation", ("gnu free documentation license",), ("1 1", "1 2", "1 3")),
    "apache": ("apache", ("apache license", "apache software license"), ("1 0", "1 1", "2 0")),
    "mit": ("mit license", ("mit license",), ()),
    "bsd-2-clause": ("bsd", ("bsd 2 clause", "simplified bsd", "freebsd license", "2 clause bsd"), ()),
    "bsd-3-clause": ("bsd", ("bsd 3 clause", "new bsd license", "modified bsd license", "3 clause bsd"), ()),
    "bsd-4-clause": ("bsd", ("bsd 4 clause", "original bsd license", "4 clause bsd"), ()),
    "bsd": ("bsd license", ("bsd license",), ()),
    "mpl": ("mozilla public", ("mozilla public license",), ("1 0", "1 1", "2 0")),
    "mpl-short": ("mpl", ("mpl",), ("1 0", "1 1", "2 0")),
    "epl": ("eclipse public", ("eclipse public license",), ("1 0", "2 0")),
    "edl": ("eclipse distribution", ("eclipse distribution license",), ("1 0",)),
    "cddl": ("common development and distribution", ("common development and distribution license",), ("1 0", "1 1")),
    "cpl": ("common public", ("common public license",), ("1 0",)),
    "ipl": ("ibm public", ("ibm public license",), ("1 0",)),
    "eupl": ("european union public", ("european union public licence", "european union public license"), ("1 0", "1 1", "1 2")),
    "cecill": ("cecill", ("cecill", "cecill license"), ("1", "2", "2 1")),
    "artistic": ("artistic license", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
    "boost": ("boost software", ("boost software license",), ("1 0",)),
    "zlib": ("zlib", ("zlib license", "zlib libpng license"), ()),
    "isc": ("isc license", ("isc license",), ()),
    "unlicense": ("unlicense", ("unlicense",), ()),
    "wtfpl": ("do what the", ("do what the fuck you want to public license",), ("1", "2")),
    "python": ("python software foundation", ("python software foundation license",), ("2",)),
    "php": ("php license", ("php license",), ("3 0", "3 01")),
    "ruby": ("ruby license", ("ruby license",), ()),
    "openssl": ("openssl license", ("openssl license",), ()),
    "postgresql": ("postgresql license", ("postgresql license",), ()),
    "ncsa": ("ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), ()),
    "ofl": ("open font license", ("sil open font license", "open font license"), ("1 0", "1 1")),
    "odbl": ("open database license", ("open database license", "odc open database license"), ("1 0",)),
    "pddl": ("public domain dedication and license", ("public domain dedication and license",), ("1 0",)),
    "odc-by": ("odc attribution", ("odc attribution license",), ("1 0",)),
    "ms-pl": ("microsoft public", ("microsoft public license",), ()),
    "ms-rl": ("microsoft reciprocal", ("microsoft reciprocal license",), ()),
    "osl": ("open software license", ("open software license",), ("1 0", "2 0", "3 0")),
    "afl": ("academic free license", ("academic free license",), ("2 0", "2 1", "3 0")),
    "upl": ("universal permissive", ("universal permissive license",), ("1 0",)),
    "bsl": ("business source license", ("business source license",), ("1 0", "1 1")),
    "sspl": ("server side public", ("server side public license",), ("1",)),
    "elastic": ("elastic license", ("elastic license",), ("2 0",)),
    "qpl": ("q public license", ("q public license",), ("1 0",)),
    "sleepycat": ("sleepycat", ("sleepycat license",), ()),
    "vim": ("vim license", ("vim license",), ()),
    "w3c": ("w3c software", ("w3c software notice and license", "w3c software and document license"), ()),
    "x11": ("x11 license", ("x11 license",), ()),
    "curl": ("curl license", ("curl license",), ()),
}
#: Parts of the share-alike family in its written order; every ordered choice makes a label of its own.
CC_PARTS = ("", "sa", "nc", "nd", "nc sa", "nc nd")
CC_WORDS = {"": "", "sa": " share ?alike", "nc": " non ?commercial", "nd": " no ?deriv(?:s|atives)", "nc sa": " non ?commercial share ?alike", "nc nd": " non ?commercial no ?deriv(?:s|atives)"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences that stand in the texts of licenses themselves.
SENTENCES = (
    ("permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of", "neither the name of .{1,80}? nor the names of (?:its|any|the) contributors", "bsd-3-clause"),
    ("all advertising materials", "all advertising materials mentioning features or use of this software", "bsd-4-clause"),
    ("this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you may not use this file except", "you may not use this file except in compliance with the license", "apache"),
    ("this source code form is subject", "this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered", "this is free and unencumbered software released into the public domain", "unlicense"),
    ("distributed under the boost", "distributed under the boost software license", "boost"),
    ("altered source versions", "altered source versions must be plainly marked as such", "zlib"),
    ("all rights reserved", "all rights reserved", "proprietary"),
    ("public domain", "(?:released into|placed in|dedicated to) the public domain", "public-domain"),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("proprietary and confidential", "proprietary and confidential", "proprietary"),
    ("the above copyright notice", "the above copyright notice and this permission notice shall be included in all copies", "mit"),
    ("the software is provided as is", "the software is provided as is without warranty of any kind express or implied", "mit"),
    ("the software is provided as is", "the software is provided as is and the author disclaims all warranties", "isc"),
    ("redistributions of source code", "redistributions of source code must retain the above copyright notice", "bsd"),
    ("redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", "bsd"),
    ("views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause"),
    ("endorse or promote products", "used to endorse or promote products derived from this software without (?:specific )?prior written permission", "bsd-3-clause"),
    ("licensed to the apache software", "licensed to the apache software foundation asf under one or more contributor license agreements", "apache"),
    ("unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this product includes software", "this product includes software developed (?:by|at) the apache software foundation", "apache"),
    ("openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("origin of this software", "the origin of this software must not be misrepresented", "zlib"),
    ("you should have received a copy", "you should have received a copy of the gnu general public license along with", "gpl"),
    ("you should have received a copy", "you should have received a copy of the gnu (?:lesser|library) general public license along with", "lgpl"),
    ("you should have received a copy", "you should have received a copy of the gnu affero general public license along with", "agpl"),
    ("copy distribute and or modify", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl"),
    ("everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim (?:copies of|or modified copies of) this license document", "license-text"),
    ("copyleft license for software", "the gnu general public license is a free copyleft license for software", "gpl"),
    ("subject to the terms of the common", "the contents of this file are subject to the terms of the common development and distribution license", "cddl"),
    ("subject to the mozilla", "the contents of this file are subject to the mozilla public license", "mpl"),
    ("accompanying materials are made", "this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("accompanying materials are made", "this program and the accompanying materials are made available under the terms of the common public license", "cpl"),
    ("permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee", "historical"),
    ("in no event shall the author", "in no event shall the authors? be liable for any special direct indirect or consequential damages", "isc"),
    ("anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("you just do what the", "you just do what the fuck you want to", "wtfpl"),
    ("reserved font name", "with reserved font name", "ofl"),
    ("sold by itself", "may be bundled redistributed and or sold with any software .{1,80}? sold by itself", "ofl"),
    ("waived all copyright", "(?:has|have) waived all copyright and related or neighboring rights", "cc0"),
    ("to the extent possible under law", "to the extent possible under law", "cc0"),
    ("you are free to share", "you are free to share copy (?:and )?distribute and transmit the work", "cc"),
    ("some rights reserved", "some rights reserved", "cc"),
    ("free for personal use", "free for personal use(?: only)?", "non-commercial"),
    ("non commercial", "for (?:personal and )?non commercial (?:use|purposes)(?: only)?", "non-commercial"),
    ("noncommercial", "for (?:personal and )?noncommercial (?:use|purposes)(?: only)?", "non-commercial"),
    ("under the same terms as perl", "under the same terms as perl itself", "perl"),
    ("under the same terms as ruby", "under the same terms as ruby itself", "ruby"),
    ("dual licensed under", "dual licensed under", "dual"),
    ("end user license agreement", "end user license agreement", "eula"),
    ("trade secret", "(?:confidential|proprietary) (?:information )?(?:and|or) trade secrets? of", "proprietary"),
    ("express written permission", "without (?:the )?(?:prior )?express written permission of", "proprietary"),
    ("unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
    ("permission is granted to anyone", "permission is granted to anyone to use this software for any purpose including commercial applications", "zlib"),
    ("beer ware", "beer ware license", "beerware"),
    ("buy me a beer", "you can buy me a beer in return", "beerware"),
)
#: Words of the families' SPDX identifiers, before a version; those that are not here are named as the family is.
SPDX = {"bsd": (), "edl": (), "boost": ("bsl",), "bsl": ("busl",), "python": ("python", "psf")}
SPDX_KEY = "spdx license identifier"
NAMED_BY_SHORT = {"gpl-short": "gpl", "lgpl-short": "lgpl", "agpl-short": "agpl", "mpl-short": "mpl"}


def rules() -> list[tuple[str, str, str, int, float]]:
    """keyword, pattern, label, priority (smaller first), confidence. Patterns match from the space before a word to its last letter."""
    out: list[tuple[str, str, str, float]] = []
    for family, (key, forms, versions) in FAMILIES.items():
        name = NAMED_BY_SHORT.get(family, family)
        body = "(?:" + "|".join(forms) + ")"
        sure = 0.7 if family.endswith("-short") else 0.8
        for v in versions:
            label, v = f"{name}-{v.replace(' ', '.')}", v if " " in v else f"{v}(?: 0)?"
            out.append((key, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{body} ?v?(?:version )?{v} or (?:any )?later", f"{label}-or-later", 1.0))
            out.append((key, f"{body} ?v?(?:version )?{v} or (?:any )?later", f"{label}-or-later", 0.95))
            out.append((key, f"{body} ?v?(?:version )?{v}", label, 0.9))
        out.append((key, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{body}", name, 0.85))
        out.append((key, f"spdx license identifier {body}", name, 1.0))
        out.append((key, body, name, sure))
    for part in CC_PARTS:
        label = "-".join(["cc-by", *part.split()])
        for v in CC_VERSIONS:
            out.append(("cc by", f"cc by{f' {part}' if part else ''} {v}", f"{label}-{v.replace(' ', '.')}", 0.95))
            out.append(("creative commons", f"creative commons attribution{CC_WORDS[part]} {v}(?: (?:international|unported|generic))?", f"{label}-{v.replace(' ', '.')}", 0.95))
        out.append(("cc by", f"cc by{f' {part}' if part else ''}", label, 0.8))
        out.append(("creative commons", f"creative commons attribution{CC_WORDS[part]}", label, 0.8))
    for family, (_, _, versions) in FAMILIES.items():
        if family in NAMED_BY_SHORT:
            continue
        for stem in SPDX.get(family, (family.replace("-", " "),)):
            for v in versions:
                label, one = f"{family}-{v.replace(' ', '.')}", f"{SPDX_KEY} {stem} {v if ' ' in v else f'{v}(?: 0)?'}"
                out.append((SPDX_KEY, f"{one} or later", f"{label}-or-later", 1.0))
                out.append((SPDX_KEY, f"{one}(?: only)?", label, 1.0))
            out.append((SPDX_KEY, f"{SPDX_KEY} {stem}", family, 1.0))
    out += [(SPDX_KEY, f"{SPDX_KEY} {words}", words.replace(" ", "-"), 1.0) for words in ("mit 0", "0bsd")]
    out += [(key, pattern, label, 0.9) for key, pattern, label in SENTENCES]
    return [(key, f" (?:{pattern})(?= )", label, i, sure) for i, (key, pattern, label, sure) in enumerate(out)]


_DELIMITERS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(text: Column) -> Column:
    """' word word ' in lower case; a single space for a text without words."""
    one = F.translate(F.coalesce(text, F.lit("")), _UPPER + _DELIMITERS, _UPPER.lower() + " " * len(_DELIMITERS))
    return F.regexp_replace(F.concat(F.lit(" "), one, F.lit(" ")), " {2,}", " ")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _found(t: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: what lies between matches and the matches themselves give the places."""
    between, matches = F.split(t, rule["pattern"], -1), F.regexp_extract_all(t, rule["pattern"], F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        lo = a["at"] + x["0"]
        hi = lo + x["1"]
        return F.struct(hi.alias("at"), F.concat(a["out"], F.array(F.struct(lo.alias("start"), hi.alias("stop")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda b, m: F.struct(F.length(b).cast("long").alias("0"), F.length(m).cast("long").alias("1")))
    places = F.aggregate(pairs, start, add)["out"]
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), (-p["stop"]).alias("less"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))


def detections(t: Column, table: list[tuple[str, str, str, int, float]]) -> Column:
    """Detections left after suppression, by start; start and stop are characters of the folded text.

    In the order (start, longest first, priority) a detection lies inside an earlier one exactly if it ends no later than
    the furthest end so far, so one pass over the sorted array drops the contained ones.
    """
    by: dict[str, list] = {}
    for r in table:
        by.setdefault(r[0], []).append(r)
    literal = [F.struct(F.lit(k).alias("keyword"), F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(lab).alias("label"), F.lit(pr).alias("priority"), F.lit(c).alias("confidence")) for _, p, lab, pr, c in rs]).alias("rules")) for k, rs in by.items()]
    gated = F.flatten(F.transform(F.filter(F.array(*literal), lambda g: F.contains(t, g["keyword"])), lambda g: g["rules"]))
    every = F.array_sort(F.flatten(F.transform(gated, lambda r: _found(t, r))))
    ends = F.struct(F.lit(-1).cast("long").alias("far"), F.array().cast("array<struct<start:long,stop:long,label:string,priority:int,confidence:double>>").alias("out"))

    def step(a: Column, d: Column) -> Column:
        stop = -d["less"]
        one = F.array(F.struct(d["start"].alias("start"), stop.alias("stop"), d["label"].alias("label"), d["priority"].alias("priority"), d["confidence"].alias("confidence")))
        return F.struct(F.greatest(a["far"], stop).alias("far"), F.when(stop > a["far"], F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(every, ends, step)["out"]


def scan(docs: DataFrame, text: str = "text", table: list[tuple[str, str, str, int, float]] | None = None) -> DataFrame:
    """All columns of docs, and n_words, n_base, first_word, last_word, base_labels, labels, detections, score.

    Null and empty texts have no words, labels '' and score 0; very long texts are scanned whole; of rules that find the same
    interval the earlier one stays; repeated rows give repeated results; columns of docs of the same names as the results are
    replaced by them; an empty table gives no rows.
    """
    table = rules() if table is None else table
    t = F.col("·t")
    out = docs.withColumn("·t", folded(F.col(text)))
    firsts, lasts, counts, labels = [], [], [], []
    words = _spaces(t) - 1
    for phrase, label in BASE:
        key = f" {phrase} "
        has = F.contains(t, F.lit(key))
        counts.append(F.when(has, F.regexp_count(t, F.lit(f" {phrase}(?= )")).cast("long")).otherwise(0))
        firsts.append(F.when(has, _spaces(F.substring_index(t, key, 1))))
        lasts.append(F.when(has, words - (_spaces(F.substring_index(t, key, -1))) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    gate = reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in dict.fromkeys(r[0] for r in table)])
    base = F.array_compact(F.array(*labels))
    none = F.array().cast("array<struct<start:long,stop:long,label:string,priority:int,confidence:double>>")
    out = out.withColumn("detections", F.when(gate, detections(t, table)).otherwise(none))
    found = F.transform("detections", lambda d: d["label"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    sure = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0))
    return out.select(
        *[c for c in docs.columns if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")],
        F.greatest(words, F.lit(0).cast("long")).alias("n_words"), sum(counts, F.lit(0).cast("long")).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, found)).alias("labels"), "detections", sure.alias("score"),
    )


def ungated(table: list[tuple[str, str, str, int, float]]) -> list[tuple[str, str, str, int, float]]:
    """The same rules, tried on every text: what gates must not change."""
    return [(" ", *r[1:]) for r in table]


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")
