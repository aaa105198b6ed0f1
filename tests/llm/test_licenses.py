import textwrap

from plumbline.llm import licenses
from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"

APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

# The texts as they stand in license files, headings and line breaks included.
MIT_FILE = """MIT License

Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC_FILE = """ISC License

Copyright (c) 2020 Jo Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD_FILE = """Copyright (c) 2020, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""
ENDORSE_FILE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""


def test_wrapped_license_files(spark):
    files = [("MIT", MIT_FILE), ("ISC", ISC_FILE), ("BSD-2-Clause", BSD_FILE.format("")), ("BSD-3-Clause", BSD_FILE.format(ENDORSE_FILE))]
    rows = []
    for name, text in files:
        lines = text.split("\n")
        rows += [(name, text), (name, text.replace("\n", "\r\n")), (name, "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint x;")]
        rows += [(name, "\n".join(f"{m} {x}".rstrip() for x in lines)) for m in ("//", "#", ";;")]
        rows += [(name, "\n".join(textwrap.fill(p, w) for p in text.split("\n\n"))) for w in (30, 55)]
    rows += [("Apache-2.0", "Released under the Apache\nLicense, Version 2.0."), ("CC-BY-4.0", "This work is licensed under the Creative\nCommons Attribution 4.0\nInternational License")]
    rows += [("", "Licensed under the MIT. License"), ("", "Released under the MIT\n\nLicense")]
    rows += [("MIT", "My Tool\nReleased under the MIT License\nUsage\nRun it|now"), ("MIT", "a | b\nReleased under the MIT License")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert [(r.doc_id, ",".join(r.licenses)) for r in licenses.scan(df).collect()] == [(n, n) for n, _ in rows]


def test_query_matches_sql(same_as_sql):
    assert same_as_sql("op1_license_sentences", SF) > 0


def test_driver_lines_are_found(spark):
    got = QUERIES["op1_license_sentences"](spark, SF).where("licenses <> ''").groupBy("licenses").count().collect()
    assert {"Apache-2.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0"} <= {r.licenses for r in got}


def test_notices_and_order(spark):
    rows = [
        (1, APACHE), (2, BSD.format("")), (3, BSD.format(ENDORSE)), (4, GPL), (5, "Some words.\nReleased under the MIT License.\nMore."),
        (6, "Ask for a license. This is as is."), (7, None), (8, ""), (9, "SPDX-License-Identifier: MPL-2.0"),
        (10, "Licensed under CC BY-NC 4.0. Released under the MIT License."), (11, "word " * 50000 + ". Licensed under the ISC License."),
        (None, "Released under the MIT License."), (1, APACHE),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")
    out = licenses.scan(df).collect()
    got = [(r.doc_id, ",".join(r.licenses)) for r in out]
    assert got == [
        (1, "Apache-2.0"), (2, "BSD-2-Clause"), (3, "BSD-3-Clause"), (4, "GPL-3.0-or-later"), (5, "MIT"), (6, ""), (7, ""), (8, ""),
        (9, "MPL-2.0"), (10, "CC-BY-NC-4.0,MIT"), (11, "ISC"), (None, "MIT"), (1, "Apache-2.0"),
    ]
    assert out[5].sentence_ids == ["?", "?"] and out[5].n_unclaimed == 2  # each sentence with a licence-like word
    assert licenses.scan(df.limit(0)).count() == 0


def test_plan_is_one_native_pass(spark):
    plan = QUERIES["op1_license_sentences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


ZLIB_FILE = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented."""
ORGANISATION = ENDORSE_FILE.replace("the copyright holder", "the Example University of Applied Arts").replace("its\n", "its\n")
HOLDERS = {
    "BSD-3-Clause": [
        BSD_FILE.format(ORGANISATION),
        BSD_FILE.format(ORGANISATION).replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS"),
        BSD_FILE.format("3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n\n"),
    ],
    "": [BSD_FILE.format("3. Products of rivals may never be used to endorse the software or its users.\n\n")],
    "MIT": [MIT_FILE.replace("THE\nAUTHORS OR COPYRIGHT HOLDERS", "EXAMPLE\nWORKS INC")],
    "Zlib": [ZLIB_FILE],
    "0BSD": [ISC_FILE.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")],
}


def test_names_of_holders_and_foreign_clauses(spark):
    rows = [(name, t.replace("\n", end)) for name, texts in HOLDERS.items() for t in texts for end in ("\n", "\r\n", "\n * ")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, ",".join(r.licenses)) for r in got] == [(n, n) for n, _ in rows]
    assert all("?" in r.sentence_ids for r in got if not r.doc_id)


def test_sql_agrees_on_wrapped_files(spark, tmp_path):
    import duckdb

    files = [MIT_FILE, ISC_FILE, BSD_FILE.format(""), BSD_FILE.format(ENDORSE_FILE), *[t for ts in HOLDERS.values() for t in ts], APACHE, GPL]
    texts = [t.replace("\n", end) for t in files for end in ("\n", "\r\n", "\n// ", "\n\n")] + [textwrap.fill(t, w) for t in files for w in (30, 60)]
    texts += ["Released under the MIT\nLicense\nLicensed under the ISC\nLicense|x", "a.\n\nb|warranty", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLES["op1_license_sentences"])
    want = {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    for r in QUERIES["op1_license_sentences"](spark, str(tmp_path)).collect():
        assert r.asDict() == want[r.doc_id], texts[r.doc_id]
    assert sum(bool(w["licenses"]) for w in want.values()) > 40
