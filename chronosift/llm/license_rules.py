"""License scans by sentence rules, in DataFrame functions alone.

A text is put in a normal form (lower case, runs of other characters than
letters and digits one space) in which line breaks and sentence ends are still
told apart. Comment marks before lines go. A sentence ends at punctuation, blank
lines and list marks; a single line break may be inside a sentence or its end,
so that wrapped notices and lines without punctuation are both found. Known
licence sentences have identifiers (``SENTENCES``, and the wordings of published
notices in ``NOTICES``); a document is the sequence of those it has. Ordered rules,
each a sequence of identifiers that must follow one another, then name
licences; what a rule has matched is taken out before the next is tried, so
that a notice counts as its most specific licence. A sentence that names several
licences (an SPDX expression, a choice of two) stands for one identifier each.
Reserved rights make a document proprietary only where no notice follows them.

``oracle()`` is the same program in SQL.

Cases: a null or empty text has no sentences; a text of any length is read whole,
as one value; of wordings that match at one place the first listed counts, and
of rules the first, so that there are no ties; repeated rows give repeated
results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normal form, by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    8: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    9: "this work is licensed under the gnu general public license version 3",
    10: "this work is licensed under the gnu general public license version 2",
    11: "this program is free software",
    12: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    13: "either version 3 of the license or at your option any later version",
    14: "either version 2 of the license or at your option any later version",
    15: "licensed under cc by nc 4 0",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "this work is licensed under a creative commons attribution 4 0 international license",
    19: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "spdx license identifier apache 2 0",
    25: "spdx license identifier mit",
    26: "spdx license identifier gpl 3 0 only",
    27: "spdx license identifier gpl 2 0 only",
    28: "spdx license identifier bsd 3 clause",
    29: "all rights reserved",
    30: "this source code form is subject to the terms of the mozilla public license v 2 0",
}

# Fixed values: (licence, sequence of sentence identifiers), the first tried first.
RULES = (
    ("Apache-2.0", (1, 2, 3, 4)),
    ("Apache-2.0", (1, 2, 3)),
    ("MIT", (7, 8)),
    ("GPL-3.0-or-later", (11, 12, 13)),
    ("GPL-2.0-or-later", (11, 12, 14)),
    ("BSD-3-Clause", (20, 21, 22, 23)),
    ("BSD-2-Clause", (20, 21, 22)),
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (24,)),
    ("MIT", (5,)),
    ("MIT", (6,)),
    ("MIT", (7,)),
    ("MIT", (25,)),
    ("GPL-3.0", (9,)),
    ("GPL-3.0", (26,)),
    ("GPL-2.0", (10,)),
    ("GPL-2.0", (27,)),
    ("CC-BY-NC-4.0", (15,)),
    ("CC-BY-4.0", (16,)),
    ("CC-BY-4.0", (18,)),
    ("CC-BY-SA-4.0", (17,)),
    ("CC-BY-SA-4.0", (19,)),
    ("BSD-3-Clause", (28,)),
    ("MPL-2.0", (30,)),
    ("proprietary", (29,)),
)

#: Every sentence with an identifier has one of these; other texts need no cutting.
STEMS = ("licen", "rights", "redistribut", "permission", "version", "software", "cc0")
assert all(any(s in t for s in STEMS) for t in SENTENCES.values()), "a sentence without a stem would be missed"

#: Who is licensed, and what may follow the name of the licence.
SUBJECT = "(?:(?:(?:this|the|our|all) (?:source )?(?:project|software|work|code|program|library|package|repository|repo|module|tool|file|files|script|document|documentation|content|dataset|data) (?:is|are) |it is )(?:hereby )?)?"
VERB = "(?:licensed|released|distributed|published|available|made available|provided) under (?:the terms of )?"
TAIL = "(?: license(?: md| txt)?| mit)?(?: https?(?: [a-z0-9]+){1,8})?(?: see(?: [a-z0-9]+){1,12})?"
GPL = "you can redistribute it and or modify it under the terms of the gnu {}general public license{} as published by the free software foundation"
LATER = " either version {} of the license or at your option any later version"
ATTRIBUTION = "(?:a|the) creative commons attribution {}4 0 (?:international )?(?:public )?license"

# Wordings of published notices, as regular expressions of the normal form, and the sentences they stand for.
NOTICES = (
    (SUBJECT + VERB + "the apache license version 2 0(?: the license)?" + TAIL, (1,)),
    (SUBJECT + VERB + "(?:the )?apache (?:license )?2 0(?: license)?" + TAIL, (1,)),
    ("(?:and )?you may not use (?:this file|these files|this software|this work|this project) except in compliance with the license", (2,)),
    ("you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?", (3,)),
    (SUBJECT + VERB + "(?:the |an )?mit license" + TAIL, (6,)),
    ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", (8,)),
    (SUBJECT + VERB + "the gnu general public license (?:version |v)3(?: 0)?" + TAIL, (9,)),
    (SUBJECT + VERB + "the gnu general public license (?:version |v)2(?: 0)?" + TAIL, (10,)),
    (GPL.format("", " version 3") + "|" + GPL.format("", "") + " version 3(?: of the license)?", (9,)),
    (GPL.format("", " version 2") + "|" + GPL.format("", "") + " version 2(?: of the license)?", (10,)),
    ("[a-z0-9]+(?: [a-z0-9]+){0,3} is free software", (11,)),
    (GPL.format("", "") + LATER.format("3"), (12, 13)),
    (GPL.format("", "") + LATER.format("2"), (12, 14)),
    (SUBJECT + VERB + "cc by nc 4 0(?: license)?" + TAIL, (15,)),
    (SUBJECT + VERB + ATTRIBUTION.format("noncommercial ") + TAIL, (15,)),
    (SUBJECT + VERB + "cc by 4 0(?: license)?" + TAIL, (16,)),
    (SUBJECT + VERB + "cc by sa 4 0(?: license)?" + TAIL, (17,)),
    (SUBJECT + VERB + ATTRIBUTION.format("") + TAIL, (18,)),
    (SUBJECT + VERB + ATTRIBUTION.format("sharealike ") + TAIL, (19,)),
    ("(?:and )?neither the names? of(?: [a-z0-9]+){1,16} nor the names? of (?:its|their|any|other|the)(?: [a-z0-9]+){0,3} may be used to endorse or promote products derived from this software without specific prior written permission", (23,)),
    ("spdx license identifier gpl 3 0", (26,)),
    ("spdx license identifier gpl 2 0", (27,)),
    ("apache license version 2 0 january 2004", (31,)),
    ("all advertising materials mentioning features or use of this software must display the following acknowledge?ment", (32,)),
    (GPL.format("lesser ", ""), (33,)),
    (GPL.format("lesser ", "") + LATER.format("3"), (33, 13)),
    ("either version 2 1 of the license or at your option any later version", (34,)),
    (GPL.format("lesser ", "") + LATER.format("2 1"), (33, 34)),
    (GPL.format("affero ", ""), (35,)),
    (GPL.format("affero ", "") + LATER.format("3"), (35, 13)),
    ("spdx license identifier gpl 3 0 or later", (36,)),
    ("spdx license identifier gpl 2 0 or later", (37,)),
    ("spdx license identifier bsd 2 clause", (38,)),
    ("spdx license identifier mpl 2 0", (30,)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", (39,)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", (40,)),
    ("to the extent possible under law(?: [a-z0-9]+){1,8} (?:has|have) (?:dedicated|waived) all copyright and related (?:or|and) neighbou?ring rights to this (?:work|software)(?: to the public domain worldwide)?", (41,)),
    ("(?:creative commons )?(?:legal code )?cc0 1 0 universal(?: public domain dedication)?", (41,)),
    (SUBJECT + VERB + "cc0(?: 1 0)?(?: universal)?(?: license)?" + TAIL, (41,)),
    ("this is free and unencumbered software released into the public domain", (42,)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0(?: which(?: accompanies this distribution and)? is available at https?(?: [a-z0-9]+){1,8})?", (43,)),
    ("eclipse public license (?:v |version )2 0", (43,)),
    ("boost software license version 1 0(?: august 17th 2003)?", (44,)),
    (SUBJECT + VERB + "the boost software license version 1 0" + TAIL, (44,)),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", (45,)),
    ("mozilla public license version 2 0", (46,)),
    ("this source code form is subject to the terms of the mozilla public license version 2 0", (30,)),
    ("gnu general public license version 3 29 june 2007", (47,)),
    ("gnu general public license version 2 june 1991", (48,)),
    ("gnu lesser general public license version 3 29 june 2007", (49,)),
    ("gnu lesser general public license version 2 1 february 1999", (50,)),
    ("gnu affero general public license version 3 19 november 2007", (51,)),
)

# Names of licences in expressions and choices, and the sentences that they stand for.
NAMES = {
    "apache 2 0": 24, "apache license version 2 0": 24, "apache license 2 0": 24, "mit": 25, "bsd 3 clause": 28, "bsd 2 clause": 38, "mpl 2 0": 30, "isc": 39, "0bsd": 40,
    "gpl 3 0 only": 26, "gpl 3 0": 26, "gpl 2 0 only": 27, "gpl 2 0": 27, "gpl 3 0 or later": 36, "gpl 2 0 or later": 37,
    "lgpl 3 0 only": 49, "lgpl 3 0": 49, "lgpl 2 1 only": 50, "lgpl 2 1": 50, "lgpl 3 0 or later": 52, "lgpl 2 1 or later": 53, "agpl 3 0 only": 51, "agpl 3 0": 51, "agpl 3 0 or later": 54,
    "cc by 4 0": 16, "cc by sa 4 0": 17, "cc by nc 4 0": 15, "cc0 1 0": 41, "unlicense": 42, "epl 2 0": 43, "bsl 1 0": 44, "zlib": 45,
}
NAME = "(?:" + "|".join(sorted(NAMES, key=len, reverse=True)) + ")"
EXCEPTION = "[a-z0-9]+(?: [a-z0-9]+){0,4} exception(?: [0-9]+){0,2}"
#: A tag with an expression, and a choice of two licences.
EXPRESSION = f"spdx license identifier {NAME}(?: (?:(?:or|and) {NAME}|with {EXCEPTION}))*"
CHOICE = f"{SUBJECT}(?:dual |double )?licensed (?:under|as) (?:the terms of )?(?:either )?(?:of )?(?:the )?{NAME}(?: license)? (?:or|and) (?:the )?{NAME}(?: license)?(?: licenses)?(?: at your (?:option|choice))?"
SEVERAL = f"(?:{EXPRESSION}|{CHOICE})"
#: The names in such a sentence.
NAMED = f"\\b(?:identifier|or|and|under|as|of|either|the) ({NAME})\\b"

# Rules of the published notices, tried before RULES. Rights reserved before a BSD notice are part of it, as is the notice at the end of the Apache licence.
NOTICE_RULES = (
    *(("BSD-4-Clause", (*before, 20, 21, 22, 32, 23)) for before in ((29,), ())),
    ("BSD-3-Clause", (29, 20, 21, 22, 23)),
    ("BSD-2-Clause", (29, 20, 21, 22)),
    ("LGPL-3.0-or-later", (11, 33, 13)),
    ("LGPL-2.1-or-later", (11, 33, 34)),
    ("AGPL-3.0-or-later", (11, 35, 13)),
    ("Apache-2.0", (31, 1, 2, 3, 4)),
    ("Apache-2.0", (31,)),
    ("GPL-3.0-or-later", (36,)),
    ("GPL-2.0-or-later", (37,)),
    ("BSD-2-Clause", (38,)),
    ("ISC", (39,)),
    ("0BSD", (40,)),
    ("CC0-1.0", (41,)),
    ("Unlicense", (42,)),
    ("EPL-2.0", (43,)),
    ("BSL-1.0", (44,)),
    ("Zlib", (45,)),
    ("MPL-2.0", (46,)),
    ("GPL-3.0", (47,)),
    ("GPL-2.0", (48,)),
    ("LGPL-3.0", (49,)),
    ("LGPL-2.1", (50,)),
    ("AGPL-3.0", (51,)),
    ("LGPL-3.0-or-later", (52,)),
    ("LGPL-2.1-or-later", (53,)),
    ("AGPL-3.0-or-later", (54,)),
)
#: A rule that holds only where no other matches behind it.
LAST = "proprietary"

#: All known sentences.
FORMS = "|".join([*sorted(SENTENCES.values(), key=len, reverse=True), *(p for p, _ in NOTICES), SEVERAL])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of comments, quotations and headings before a line.
COMMENT = r"(^|\n)[\x20\t\r]*(?:(?:/\*+|\*+|//+|#+|--+|;+|%+|<!--+|>+|\|+|!|dnl\b|rem\b)[\x20\t]*)+"
#: A tag before an expression, and the expression's first brackets.
TAG = r"\bspdx-license-identifier:[\x20\t]*\(*"
#: What looks like a sentence's end and is none: the colon of an SPDX tag, and these abbreviations.
NO_END = r"\b(spdx-license-identifier|v|inc|ltd|llc|co|corp)[.:](?=[\x20\t]*\n?[\x20\t]*(?:[0-9]|nor\b|[a-z]+-[0-9]|mit\b))"
#: Sentences end at list marks and blank lines, and at these before white space.
LISTED = r"(^|\n)[\x20\t]*(?:[-+•]|\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)])[\x20\t]+"
BLANK = r"\n[\x20\t\r]*(?=\n)"
ENDS = r"""[.;:!?]["')\]*_]*(?:[\x20\t\r]+|(?=\n))"""
#: Ends a sentence in the normal form, where a line break stays one.
END = "\x01"


def normal(text: Column) -> Column:
    """Normal form of a text, with line breaks and sentence ends."""
    x = F.translate(F.coalesce(text, F.lit("")), UPPER + END, LOWER + " ")
    for pattern, by in ((COMMENT, "$1"), (TAG, "spdx-license-identifier "), (NO_END, "$1 "), (LISTED, END), (BLANK, END), (ENDS, END), (f"[^a-z0-9\n{END}]+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return x


def sentences(text: Column) -> Column:
    """The known sentences of a text in normal form, in order."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    stems = low.contains(STEMS[0])
    for s in STEMS[1:]:
        stems = stems | low.contains(s)
    forms = FORMS.replace(" ", "[ \n]+")
    found = F.regexp_extract_all(normal(text), F.lit(f"(?:^|[\n{END}]) ?({forms})(?= ?(?:[\n{END}]|$))"), F.lit(1))
    return F.when(stems, F.transform(found, lambda s: F.regexp_replace(s, "[ \n]+", " "))).otherwise(F.expr("cast(array() as array<string>)"))


def identifiers(forms: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    known = F.create_map(*[x for i, s in SENTENCES.items() for x in (F.lit(s), F.array(F.lit(i)))])

    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    several = lambda s: F.transform(F.regexp_extract_all(s, F.lit(NAMED), F.lit(1)), lambda n: F.try_element_at(names, n))

    def of(s: Column) -> Column:
        notice = F.when(s.rlike(f"^{SEVERAL}$"), several(s)).otherwise(F.expr("cast(array() as array<int>)"))
        for pattern, ids in reversed(NOTICES):
            notice = F.when(s.rlike(f"^(?:{pattern})$"), F.array(*map(F.lit, ids))).otherwise(notice)
        return F.coalesce(F.try_element_at(known, s), notice)

    return F.flatten(F.transform(forms, of))


def apply_rules(ids: Column) -> Column:
    """Names of the licences whose rules match, each as often as it does, in the order of the rules."""
    start = F.struct(F.concat(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")).alias("rest"), F.expr("cast(array() as array<string>)").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq")) for name, seq in NOTICE_RULES + RULES])  # LAST is the last

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["rest"], rule["seq"], F.lit("|"))
        where = F.when(rule["name"] == LAST, F.substring_index(state["rest"], "|", -1)).otherwise(state["rest"])
        times = F.floor((F.length(where) - F.length(F.replace(where, rule["seq"], F.lit("")))) / F.length(rule["seq"])).cast("int")
        return F.struct(left.alias("rest"), F.concat(state["found"], F.array_repeat(rule["name"], times)).alias("found"))

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step)["found"]).otherwise(F.expr("cast(array() as array<string>)"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids and licenses (arrays, in order) of each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), sentences(F.col(f"`{text_col}`").cast("string")).alias("forms"))
    rows = rows.select(id_col, identifiers(F.col("forms")).alias("sentence_ids"))
    return rows.select(id_col, "sentence_ids", apply_rules(F.col("sentence_ids")).alias("licenses"))


def oracle() -> str:
    """The query op3 as DuckDB SQL. Its patterns cannot look ahead: what they would look at is taken and put back, and marks between sentences are doubled."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    end = "chr(1)"
    no_end = NO_END.replace("(?=", "(")
    ends = ENDS.replace("|(?=\\n))", "|(\\n))")
    steps_ = ((COMMENT, "'\\1'"), (TAG, "'spdx-license-identifier '"), (no_end, "'\\1 \\2'"), (LISTED, end), (r"\n(?:[\x20\t\r]*\n)+", f"{end} || chr(10)"), (ends, f"{end} || '\\1'"), (r"[^a-z0-9\n\x01]+", "' '"), (r"([\n\x01])", "'\\1\\1'"))
    normal_ = "low"
    for pattern, by in steps_:
        normal_ = f"regexp_replace({normal_}, {quoted(pattern)}, {by}, 'g')"
    forms = quoted(r"(?:^|[\n\x01]) ?(" + FORMS.replace(" ", r"[ \n]+") + r") ?(?:[\n\x01]|$)")
    known = "MAP {" + ", ".join(f"{quoted(s)}: [{i}]" for i, s in SENTENCES.items()) + "}"
    named = "MAP {" + ", ".join(f"'{n}': {i}" for n, i in NAMES.items()) + "}"
    notices = " ".join(f"WHEN regexp_full_match(x, {quoted(p)}) THEN {list(ids)}" for p, ids in NOTICES)
    of = f"coalesce(k[x], CASE {notices} WHEN regexp_full_match(x, {quoted(SEVERAL)}) THEN list_transform(regexp_extract_all(x, {quoted(NAMED)}, 1), lambda n: nm[n]) ELSE [] END)"
    rest, steps, names = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')", [], []
    rules = NOTICE_RULES + RULES
    for j, (name, seq) in enumerate(rules):
        token = "".join(f"<{i}>" for i in seq)
        where = f"regexp_extract(r{j}, '[^|]*$')" if name == LAST else f"r{j}"
        steps.append(f"s{j + 1} AS (SELECT *, replace(r{j}, '{token}', '|') AS r{j + 1}, (length({where}) - length(replace({where}, '{token}', ''))) // {len(token)} AS c{j + 1} FROM {'base' if j == 0 else f's{j}'})")
        names.append(f"list_resize(CAST([] AS VARCHAR[]), CAST(c{j + 1} AS BIGINT), '{name}')")
    found = "list_concat(" * (len(names) - 1) + names[0] + "".join(f", {n})" for n in names[1:])
    stems = " OR ".join(f"contains(low, '{s}')" for s in STEMS)
    return f"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}' || chr(1), '{LOWER} ') AS low FROM documents),
forms AS (SELECT doc_id, CASE WHEN {stems} THEN list_transform(regexp_extract_all({normal_}, {forms}, 1), lambda x: regexp_replace(x, '[ \\n]+', ' ', 'g')) ELSE CAST([] AS VARCHAR[]) END AS s FROM lowered),
known AS (SELECT {known} AS k, {named} AS nm),
base AS (SELECT doc_id, ids, {rest} AS r0 FROM (SELECT doc_id, flatten(list_transform(s, lambda x: {of})) AS ids FROM forms, known)),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string({found}, ',') AS licenses FROM s{len(rules)}
"""
