import re

import duckdb
from pyspark.sql import functions as F

from chronosift.llm import license_rules, queries
from tests.llm import helpers


def brute(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    known = {s: i for i, s in license_rules.SENTENCES.items()}
    forms = [re.sub("[^a-z0-9]+", " ", s).strip(" ") for s in re.sub(r"([.;:!?])[ \t\r]+", "\\1\n", low).split("\n")]
    ids = [known[f] for f in forms if f in known]
    rest, found = list(ids), []
    for name, seq in license_rules.RULES:
        i = 0
        while i <= len(rest) - len(seq):
            if tuple(rest[i : i + len(seq)]) == seq:
                rest[i : i + len(seq)] = [None]
                found.append(name)
            i += 1
    return ids, found


def say(*ids):
    return ". ".join(license_rules.SENTENCES[i].capitalize() for i in ids) + "."


ROWS = [
    (1, "Intro.\n" + say(1, 2, 3, 4) + "\nMore text. " + say(29)),
    (2, say(1) + " other " + say(5) + " " + say(5)),
    (3, say(7, 8, 7)),
    (4, say(2, 3)),
    (5, "x" + say(9) + "\r\n" + say(9).upper() + "\n" + say(15)),
    (6, None),
]


def test_rules_equal_brute_force(spark):
    rows = license_rules.scan(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in rows}
    assert got == {d: brute(t) for d, t in ROWS}
    assert got[1][1] == ["Apache-2.0", "proprietary"]


def test_awkward_rows(spark):
    rows = license_rules.scan(helpers.clashing(spark)).collect()
    assert len(rows) == len(helpers.awkward_rows()) and all(r.licenses == [] for r in rows)
    assert license_rules.scan(helpers.empty(spark)).count() == 0


def test_query_equals_sql_and_has_no_python(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.op3_licenses(spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(license_rules.oracle()).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.filter(F.col("licenses") != "").count() > 10


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

MIT = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"""

BSD = """Copyright (c) 2020, Some Company Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

ENDORSE = """
3. Neither the name of Some Company Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def commented(text, first, each, last):
    return first + "\n".join(each + line for line in text.split("\n")) + last


def test_published_notices(spark):
    cases = [
        (APACHE, ["Apache-2.0"]),
        (MIT, ["MIT"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + ENDORSE, ["BSD-3-Clause"]),
        (GPL, ["GPL-3.0-or-later"]),
        (GPL.replace("program is", "file is part of X.\n\nX is").replace("\n", "\r\n"), ["GPL-3.0-or-later"]),
        (GPL.replace(": you", "; you").replace("Foundation, either version 3", "Foundation; either version 2"), ["GPL-2.0-or-later"]),
        (GPL.replace("GNU General", "GNU Lesser General"), ["LGPL-3.0-or-later"]),
        (MPL, ["MPL-2.0"]),
        ("This project is licensed under the MIT License.", ["MIT"]),
        ("## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file\nfor details.", ["MIT"]),
        ("This project is not licensed under the MIT License.", []),
        ("no full stop before\nReleased under the MIT License\nnor behind", ["MIT"]),
        ("#!/bin/sh\n# SPDX-License-Identifier: Apache-2.0\n", ["Apache-2.0"]),
        ("// SPDX-License-Identifier: MIT\n", ["MIT"]),
    ]
    marks = [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", "\n"), ("<!--\n", "  ", "\n-->"), ("", "// ", "\nint x;")]
    rows = [(commented(t, *m), want) for t, want in cases for m in marks]
    got = license_rules.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: want for i, (_, want) in enumerate(rows)}


ISC = """Copyright (c) 2020, A. Writer. All rights reserved.

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""

ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented"""

EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""

MORE = [
    (ISC, ["ISC"]),
    (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), ["0BSD"]),
    (ZLIB, ["Zlib"]),
    (EPL, ["EPL-2.0"]),
    ("CC0 1.0 Universal\n\nStatement of Purpose", ["CC0-1.0"]),
    ("To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty.", ["CC0-1.0"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", ["Unlicense"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby", ["BSL-1.0"]),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file", ["BSL-1.0"]),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", ["MPL-2.0"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", ["GPL-3.0"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright", ["GPL-2.0"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright", ["LGPL-2.1"]),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright", ["AGPL-3.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0\n", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC\nint x;", ["ISC", "MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1\n", ["GPL-3.0-or-later"]),
    ("SPDX-License-Identifier: ISC\n", ["ISC"]),
    ("This project is dual-licensed under MIT or Apache-2.0.", ["Apache-2.0", "MIT"]),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("Copyright 2020 Some Company. All rights reserved.\n\n" + MIT, ["MIT"]),
    (MIT + "\n\nAll rights reserved.", ["MIT", "proprietary"]),
    ("Confidential. All rights reserved.", ["proprietary"]),
]


def oracle_of(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return {r[0]: r[1:] for r in con.execute(license_rules.oracle()).fetchall()}


def test_more_published_notices(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MORE)]
    got = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {MORE[r.doc_id][0][:60]: sorted(r.licenses) for r in got} == {t[:60]: sorted(w) for t, w in MORE}


def test_sql_equals_the_query_on_wrapped_and_commented_notices(spark):
    texts = [APACHE, MIT, BSD, BSD + ENDORSE, GPL, GPL.replace("GNU General", "GNU Lesser General"), MPL, *(t for t, _ in MORE)]
    marks = [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", "\n"), ("<!--\n", "  ", "\n-->"), ("", "// ", "\nint x;"), ("x\n", "", "\r\ny")]
    rows = [(i, commented(t, *m)) for i, (t, m) in enumerate((t, m) for t in texts for m in marks)] + [(-1, None), (-2, ""), (-3, " ".join(texts))]
    got = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = oracle_of(rows)
    assert {r.doc_id: (len(r.sentence_ids), ",".join(map(str, r.sentence_ids)), ",".join(r.licenses)) for r in got} == want
