"""Licence rules on hand-made notices, against the SQL twin and a plain scan."""

import re

import duckdb

from shelfcast.llm import licenses as L

MIT = """Some prose first. Permission is hereby granted, free of charge, to any person obtaining a copy
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

DOCS = [
    (1, MIT, ["MIT"]),
    (2, "prose | without end |\nLicensed under the Apache Licence, Version 2.0.", ["Apache-2.0"]),
    (3, "This work is licensed under the GNU General Public License, version 3. All rights reserved.",
     ["GPL-3.0-only", "all-rights-reserved"]),
    (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
    (5, "A licensed plumber came; his license was old.", []),
    (6, "No word of it.", []), (7, "", []), (8, None, []),
    (9, "Licensed under the Apache License, v2.0.\nLicensed under the Apache License, v2.0.", ["Apache-2.0"]),
    (9, "x " * 30000 + "\nReleased under the MIT License.", ["MIT"]),
    (None, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version.", ["GPL-2.0-or-later"]),
]

GNU_END = """

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} License for more details.

You should have received a copy of the GNU {name} License
along with this {what}{tail}
"""

#: The notices that the licences themselves ask for.
OFFICIAL = {
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""" + GNU_END.format(
        what="program", name="General Public", tail=".  If not, see <https://www.gnu.org/licenses/>."),
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""" + GNU_END.format(
        what="program", name="General Public", tail="; if not, write to the Free Software\nFoundation, Inc."),
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""" + GNU_END.format(
        what="library", name="Lesser General Public", tail="; if not, write to the Free Software Foundation."),
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""" + GNU_END.format(
        what="program", name="Affero General Public", tail=".  If not, see <https://www.gnu.org/licenses/>."),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
}


def commented(text, mark, first="", last=""):
    return first + "\n".join(f"{mark}{' ' + line if line else ''}" for line in text.split("\n")) + last


STYLES = {"plain": lambda t: t, "hash": lambda t: commented(t, "#"), "slashes": lambda t: commented(t, "//"),
          "star": lambda t: commented(t, " *", "/*\n", "\n */\nint main() {}"), "dashes": lambda t: commented(t, "--"),
          "semicolons": lambda t: commented(t, ";;"), "carriage": lambda t: t.replace("\n", "\r\n"),
          "after prose": lambda t: "# Tool\n\nIt does things.\n\n" + t + "\n\nimport os\n"}


def official(spark):
    rows = [(f"{name} {style}", make(text)) for name, text in OFFICIAL.items() for style, make in STYLES.items()]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_official_notices_plain_and_commented(spark):
    wrong = {r.doc_id: r.joined_ids for r in L.scan(official(spark)).collect()
             if r.licenses != [r.doc_id.split(" ")[0]]}
    assert not wrong


def test_whole_notices_match_their_longest_rules(spark):
    """Every sentence of an official notice is known and taken by one rule."""
    for r in L.scan(official(spark).where("doc_id like '% plain'")).collect():
        name, ids = r.doc_id.split(" ")[0], [i for i in r.joined_ids if i != "?"]
        assert any(rule == name and seq == ids for rule, seq in L.RULES), (name, r.joined_ids)


def frame(spark):
    return spark.createDataFrame([(i, t, "s", 1) for i, t, _ in DOCS],
                                 "doc_id long, text string, sentence_ids string, licenses int")


def test_notices(spark):
    got = sorted([(str(r.doc_id), r.licenses) for r in L.scan(frame(spark)).collect()])
    assert got == sorted((str(i), w) for i, _, w in DOCS)


def test_equals_sql(spark):
    d = frame(spark).selectExpr("string(doc_id) as doc_id", "text").union(official(spark))
    got = sorted([(str(r.doc_id), len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licenses))
                  for r in L.scan(d).collect()])
    pdf = d.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", pdf)
    want = con.execute(L.oracle()).fetchall()
    names = [c[0] for c in con.description]
    assert names == ["doc_id", "n_sentences", "sentence_ids", "licenses"]
    want = sorted((str(r[0]), *r[1:]) for r in want)
    assert got == want


def test_empty_table(spark):
    assert L.scan(frame(spark).limit(0)).count() == 0


def test_knowledge_base_is_consistent(spark):
    cue = re.compile(L.CUE)
    forms = [f for fs in L.SENTENCES.values() for f in fs]
    assert len(forms) == len(set(forms))
    assert all(cue.search(f) for f in forms), [f for f in forms if not cue.search(f)]
    assert {i for _, seq in L.RULES for i in seq} <= set(L.SENTENCES)
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    assert all(a == b for a, b in df.select("s", L.normalised(df.s)).collect())
