"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences; those that speak of licensing are normalised and
mapped to the identifiers of known licence sentences; the sequence of
identifiers is matched against ordered licence rules.  A rule that matches
consumes its sentences, so a full notice is reported once and its parts do not
match the shorter rules after it.

Two readings of a text are tried, and their licences united: lines joined
(wrapped notices) and line by line (notices under prose without a full stop).
Comment marks at the starts of lines are taken off first.  Known sentences are
stored as the splitter cuts them, so a notice with semicolons is several.

Every whole text is scanned, row by row: no join, no shuffle, no state.  The
knowledge base is the fixed table below.

Defined results: a null or empty text has no sentence and no licence; a
licensing sentence that is not known is "?" and keeps rules from matching
across it; repeated rows are reported each; an empty table gives an empty one;
other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _terms(family: str) -> str:
    return f"under the terms of the gnu {family} license as published by the free software foundation"


def _free(family: str, version: str) -> list[str]:
    """The grant of a GNU licence in one sentence, after "is free software" or with it."""
    grant = f"you can redistribute it and or modify it {_terms(family)} either version {version} of the license or at your option any later version"
    return [grant, f"this program is free software {grant}", f"this library is free software {grant}"]


#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache2-short": ["licensed under the apache license version 2.0",
                      "this project is licensed under the apache license version 2.0",
                      "this work is licensed under the apache license version 2.0",
                      "released under the apache license version 2.0",
                      "licensed under the apache license version 2.0 the license"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-at": ["you may obtain a copy of the license at"],
    "apache2-url": ["http www.apache.org licenses license 2.0", "https www.apache.org licenses license 2.0"],
    "apache2-copy": ["you may obtain a copy of the license at https www.apache.org licenses license 2.0",
                     "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "apache2-asis": ["unless required by applicable law or agreed to in writing software distributed under the "
                     "license is distributed on an as is basis without warranties or conditions of any kind "
                     "either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the "
                    "license"],
    "mit-short": ["released under the mit license", "licensed under the mit license",
                  "this project is licensed under the mit license", "this work is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and "
                  "associated documentation files the software to deal in the software without restriction "
                  "including without limitation the rights to use copy modify merge publish distribute sublicense "
                  "and or sell copies of the software and to permit persons to whom the software is furnished to "
                  "do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or "
                   "substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not "
                 "limited to the warranties of merchantability fitness for a particular purpose and "
                 "noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other "
                      "liability whether in an action of contract tort or otherwise arising from out of or in "
                      "connection with the software or the use or other dealings in the software"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions "
                   "and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions "
                   "and the following disclaimer in the documentation and or other materials provided with the "
                   "distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                  "or promote products derived from this software without specific prior written permission"],
    "bsd2-short": ["licensed under the bsd 2 clause license"],
    "bsd3-short": ["licensed under the bsd 3 clause license"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee "
                  "is hereby granted provided that the above copyright notice and this permission notice appear in "
                  "all copies"],
    "gnu-program": ["this program is free software", "this file is free software", "this software is free software"],
    "gnu-library": ["this library is free software"],
    "gpl-terms": [f"you can redistribute it and or modify it {_terms('general public')}"],
    "lgpl-terms": [f"you can redistribute it and or modify it {_terms('lesser general public')}",
                   f"you can redistribute it and or modify it {_terms('library general public')}"],
    "agpl-terms": [f"you can redistribute it and or modify it {_terms('affero general public')}"],
    "gpl2-terms-only": ["you can redistribute it and or modify it under the terms of the gnu general public license "
                        "version 2 as published by the free software foundation",
                        "you can redistribute it and or modify it under the terms of version 2 of the gnu general "
                        "public license as published by the free software foundation"],
    "later-2": ["either version 2 of the license or at your option any later version"],
    "later-2.1": ["either version 2.1 of the license or at your option any later version"],
    "later-3": ["either version 3 of the license or at your option any later version"],
    "gpl2-later": _free("general public", "2"),
    "gpl3-later": _free("general public", "3"),
    "lgpl2.1-later": _free("lesser general public", "2.1"),
    "lgpl3-later": _free("lesser general public", "3"),
    "agpl3-later": _free("affero general public", "3"),
    "gpl2-short": ["licensed under the gnu general public license version 2",
                   "this work is licensed under the gnu general public license version 2"],
    "gpl3-short": ["this work is licensed under the gnu general public license version 3",
                   "licensed under the gnu general public license version 3"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without "
                 "even the implied warranty of merchantability or fitness for a particular purpose"],
    "gnu-hope": ["this program is distributed in the hope that it will be useful but without any warranty",
                 "this library is distributed in the hope that it will be useful but without any warranty"],
    "gnu-even": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "lgpl-see": ["see the gnu lesser general public license for more details"],
    "agpl-see": ["see the gnu affero general public license for more details"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl-copy": ["you should have received a copy of the gnu lesser general public license along with this program",
                  "you should have received a copy of the gnu lesser general public license along with this library"],
    "agpl-copy": ["you should have received a copy of the gnu affero general public license along with this program"],
    "gnu-not": ["if not see http www.gnu.org licenses", "if not see https www.gnu.org licenses"],
    "agpl3-short": ["licensed under the gnu affero general public license version 3"],
    "lgpl3-short": ["licensed under the gnu lesser general public license version 3"],
    "mpl2-subject": ["this source code form is subject to the terms of the mozilla public license version 2.0"],
    "ccby4-short": ["licensed under cc by 4.0",
                    "this work is licensed under a creative commons attribution 4.0 international license"],
    "ccbysa4-short": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution "
                      "sharealike 4.0 international license"],
    "ccbync4-short": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution "
                      "noncommercial 4.0 international license"],
    "cc0-short": ["released under cc0 1.0", "licensed under cc0 1.0"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

_APACHE = ["apache2-short", "apache2-comply"]
_ASIS = ["apache2-asis", "apache2-see"]
_HOPE = ["gnu-hope", "gnu-even"]
#: What may follow the grant of a GNU licence, longest first.
_GNU_ENDS = {f: [[*_HOPE, f"{f}-see", f"{f}-copy", "gnu-not"], [*_HOPE, f"{f}-see", f"{f}-copy"], [*_HOPE, f"{f}-see"], _HOPE, []]
             for f in ("gpl", "lgpl", "agpl")}
#: Licences with the sentences of their grants, as the splitter cuts them.
_GNU_GRANTS = [
    ("LGPL-2.1-or-later", "lgpl", ["gnu-library", "lgpl-terms", "later-2.1"]),
    ("LGPL-2.1-or-later", "lgpl", ["gnu-program", "lgpl-terms", "later-2.1"]),
    ("LGPL-2.1-or-later", "lgpl", ["gnu-program", "lgpl2.1-later"]),
    ("LGPL-2.1-or-later", "lgpl", ["gnu-library", "lgpl2.1-later"]),
    ("LGPL-2.1-or-later", "lgpl", ["lgpl2.1-later"]),
    ("LGPL-3.0-or-later", "lgpl", ["gnu-library", "lgpl-terms", "later-3"]),
    ("LGPL-3.0-or-later", "lgpl", ["gnu-program", "lgpl-terms", "later-3"]),
    ("LGPL-3.0-or-later", "lgpl", ["gnu-program", "lgpl3-later"]),
    ("LGPL-3.0-or-later", "lgpl", ["gnu-library", "lgpl3-later"]),
    ("LGPL-3.0-or-later", "lgpl", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", "agpl", ["gnu-program", "agpl-terms", "later-3"]),
    ("AGPL-3.0-or-later", "agpl", ["gnu-program", "agpl3-later"]),
    ("AGPL-3.0-or-later", "agpl", ["agpl3-later"]),
    ("GPL-3.0-or-later", "gpl", ["gnu-program", "gpl-terms", "later-3"]),
    ("GPL-3.0-or-later", "gpl", ["gnu-program", "gpl3-later"]),
    ("GPL-3.0-or-later", "gpl", ["gpl3-later"]),
    ("GPL-2.0-or-later", "gpl", ["gnu-program", "gpl-terms", "later-2"]),
    ("GPL-2.0-or-later", "gpl", ["gnu-program", "gpl2-later"]),
    ("GPL-2.0-or-later", "gpl", ["gpl2-later"]),
    ("GPL-2.0-only", "gpl", ["gnu-program", "gpl2-terms-only"]),
]

#: Licences with the sentences that state them, longest notices first.
RULES = [
    ("Apache-2.0", [*_APACHE, "apache2-at", "apache2-url", *_ASIS]),
    ("Apache-2.0", [*_APACHE, "apache2-copy", *_ASIS]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    *[(name, grant + end) for name, family, grant in _GNU_GRANTS for end in _GNU_ENDS[family] if end],
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope"]),
    ("Apache-2.0", _APACHE),
    *[(name, grant) for name, _, grant in _GNU_GRANTS],
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("AGPL-3.0-only", ["agpl3-short"]),
    ("LGPL-3.0-only", ["lgpl3-short"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("Unlicense", ["public-domain"]),
    ("all-rights-reserved", ["reserved"]),
]

#: A sentence without any of these says nothing of licensing.
CUES = ("licen[cs]", "copyright", "warrant", "redistribut", "permission", "public domain",
        "rights reserved", "free software", "cc0")
CUE = "(?i)" + "|".join(CUES)
_BREAK = "\x01"
#: Marks of comments at the start of a line, and "v. 2" that is no sentence's end.
COMMENT = r"(^|\n)[ \t]*(?:#+|//+|/[*]+|[*]+/?|--+|;+|%+|<!--)"
VERSION = r"\b([vV])[.][ \t\r\n\f]+([0-9])"


def sentences(text: Column) -> tuple[Column, Column]:
    """The licensing sentences of the two readings, as they stand."""
    body = F.regexp_replace(F.translate(text, _BREAK, " "), COMMENT, "$1")
    body = F.regexp_replace(body, VERSION, "$1$2")
    joined = F.translate(F.regexp_replace(body, r"\n[ \t\r\f]*\n", _BREAK), "\n", " ")
    lines = F.translate(body, "\n", _BREAK)
    return tuple(F.filter(F.split(F.regexp_replace(x, r"([.!?;:])[ \t\r\n\f]+", "$1" + _BREAK), _BREAK),
                          lambda s: s.rlike(CUE)) for x in (joined, lines))


def normalised(sentence: Column) -> Column:
    """Lower case, "license" for "licence", "version 2" for "v2"; what is not a
    letter, a digit or a point is one space; no point or space at the ends."""
    s = F.regexp_replace(F.lower(sentence), "licence", "license")
    s = F.regexp_replace(s, "[^a-z0-9.]+", " ")
    s = F.regexp_replace(s, r"\bv[. ]*([0-9])", "version $1")
    return F.regexp_replace(s, r"^[. ]+|[. ]+$", "")


def _known() -> Column:
    pairs = [F.lit(x) for name, forms in SENTENCES.items() for form in forms for x in (form, name)]
    return F.create_map(*pairs)


def identifiers(found: Column) -> Column:
    """Identifiers of licensing sentences in order, "?" where unknown."""
    known = _known()
    return F.transform(found, lambda s: F.coalesce(F.element_at(known, normalised(s)), F.lit("?")))


def _sequence(ids: list[str]) -> str:
    return "".join(f"|{i}|" for i in ids)


def matched(ids: Column) -> Column:
    """Licences whose rules match the identifier sequence, in rule order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq"))
                      for name, seq in RULES])
    text = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    start = F.struct(text.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.contains(acc["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["seq"], F.lit("|-|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rules, start, step)["found"]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``sentence_ids`` (line by line), ``joined_ids`` (lines
    joined) and ``licenses``, arrays of strings, per document."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    speaks = body.rlike(CUE)  # most texts end here
    joined, lines = sentences(body)
    x = docs.select(*[F.col(f"`{c}`") for c in keep],
                    F.when(speaks, identifiers(lines)).otherwise(none).alias("sentence_ids"),
                    F.when(speaks, identifiers(joined)).otherwise(none).alias("joined_ids"))
    either = F.array_sort(F.array_union(matched(F.col("joined_ids")), matched(F.col("sentence_ids"))))
    some = F.size("sentence_ids") + F.size("joined_ids") > 0
    return x.withColumn("licenses", F.when(some, either).otherwise(none))


def oracle(doc_table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, sentence_ids, licenses`` as joined strings."""
    forms = " ".join(f"WHEN '{form}' THEN '{name}'" for name, all_forms in SENTENCES.items() for form in all_forms)
    norm = "lower(s)"
    for old, new in (("licence", "license"), ("[^a-z0-9.]+", " "), (r"\bv[. ]*([0-9])", r"version \1"),
                     (r"^[. ]+|[. ]+$", "")):
        norm = f"regexp_replace({norm}, '{old}', '{new}', 'g')"

    def ids(body: str) -> str:
        cut = f"string_split(regexp_replace({body}, '([.!?;:])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))"
        return (f"list_transform(list_filter({cut}, lambda s: regexp_matches(s, '{CUE}')), "
                f"lambda s: CASE {norm} {forms} ELSE '?' END)")

    body = f"regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{COMMENT}', '\\1', 'g')"
    body = f"regexp_replace({body}, '{VERSION}', '\\1\\2', 'g')"
    joined = f"replace(regexp_replace({body}, '\n[ \t\r\f]*\n', chr(1), 'g'), chr(10), ' ')"
    steps, last = [], "a0"
    for i, (name, seq) in enumerate(RULES):
        mark = _sequence(seq)
        steps.append(f"a{i + 1} AS (SELECT * REPLACE (replace(j, '{mark}', '|-|') AS j, replace(l, '{mark}', '|-|') AS l, "
                     f"CASE WHEN contains(j, '{mark}') OR contains(l, '{mark}') THEN list_append(found, '{name}') "
                     f"ELSE found END AS found) FROM {last})")
        last = f"a{i + 1}"
    return (f"WITH s AS (SELECT doc_id, {ids(f'replace({body}, chr(10), chr(1))')} AS line_ids, {ids(joined)} AS joined_ids "
            f"FROM {doc_table}), a0 AS (SELECT doc_id, line_ids, '|' || array_to_string(joined_ids, '||') || '|' AS j, "
            "'|' || array_to_string(line_ids, '||') || '|' AS l, CAST([] AS VARCHAR[]) AS found FROM s), "
            + ", ".join(steps)
            + " SELECT doc_id, CAST(len(line_ids) AS BIGINT) AS n_sentences, array_to_string(line_ids, ',') AS sentence_ids, "
            f"array_to_string(list_sort(list_distinct(found)), ',') AS licenses FROM {last}")
