"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised, and known licence sentences become
identifiers. A licence rule is an ordered sequence of identifiers; it holds where its identifiers follow
one another among the text's known sentences. Only built-in expressions run on the row itself: no join,
no shuffle. Every known sentence holds one of a few anchor words, which normalising leaves as they are, so
a text without any of them holds no known sentence and is not cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import documents, text_or_empty

# Licence names as notices spell them, by SPDX identifier.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"),
    "GPL-2.0-only": ("GPL-2.0-only",), "GPL-2.0-or-later": ("GPL-2.0-or-later",), "GPL-3.0-only": ("GPL-3.0-only",), "GPL-3.0-or-later": ("GPL-3.0-or-later",),
    "LGPL-2.1-only": ("LGPL-2.1-only",), "LGPL-2.1-or-later": ("LGPL-2.1-or-later",), "LGPL-3.0-only": ("LGPL-3.0-only",), "LGPL-3.0-or-later": ("LGPL-3.0-or-later",),
    "AGPL-3.0-only": ("AGPL-3.0-only",), "AGPL-3.0-or-later": ("AGPL-3.0-or-later",),
}
# Ways to name a licence in one sentence.
FRAMES = (
    "Licensed under {the}{name}", "Released under {the}{name}", "Distributed under {the}{name}", "Available under {the}{name}",
    "This work is licensed under {the}{name}", "This project is licensed under {the}{name}", "This software is licensed under {the}{name}",
    "This program is licensed under {the}{name}", "This file is licensed under {the}{name}", "SPDX-License-Identifier: {name}", "License: {name}",
)
# Sentences of licence texts and notices, in order, by rule.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "you may not use this file except in compliance with the License.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# Further sentences of licence texts and notices, in order, by rule.
FURTHER = (
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",)),
    ("LGPL-2.1-or-later", ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",)),
    ("LGPL-3.0-or-later", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    ("AGPL-3.0-or-later", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    ("GPL-2.0-only", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",)),
    ("0BSD", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    ("BSL-1.0", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",)),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    )),
)
# Sentences that go with licence texts and notices and decide no rule by themselves.
WITH_TEXTS = (
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "See the License for the specific language governing permissions and limitations under the License.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.",
    "See the GNU Lesser General Public License for more details.",
    "See the GNU Affero General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)
#: A rule that another one's text goes on from is not reported where the longer one holds.
INSIDE = {"BSD-2-Clause": "BSD-3-Clause"}
#: Every known sentence holds one of these, in lower case, or the word "under". They are parts of single words,
#: so normalising neither makes nor breaks them.
ANCHORS = ("licens", "permi", "copyright", "software", "unencumbered", "redistribut", "mpl")
UNDER = r"(?:^|[^a-z0-9])under(?:[^a-z0-9]|$)"

#: A sentence ends after one of these marks and white space, or with its line.
BREAK = r"\n+|[.!?](?:[\x20\t\r]+|$)"
NOISE = r"[^a-z0-9]+"
#: A line end inside a paragraph, with the next line's comment leader: no blank line and no list item follows. It
#: becomes JOINT, and the lines between two other ends are also read as one sentence, from each of them on.
LEADER = r"(?://+|#+|\*+|;+|--+|>+|%+|'+|(?:rem|dnl)[\x20\t])"
WRAP = rf"\n[\x20\t]*+(?:{LEADER}[\x20\t]*+)?+(?![\x20\t\r]*\n|\(?(?:[a-z]|\d{{1,2}})[.)][\x20\t])"
JOINT = "\x01"
BREAK_JOINED = r"\n+|[.!?](?:[\x20\t\r\x01]+|$)"


#: What normalising leaves of a comment's leader that is a word.
WORD_LEADER = r"^(?:rem|dnl) "


def normal(sentence: str) -> str:
    return re.sub(WORD_LEADER, "", re.sub(NOISE, " ", sentence.lower()).strip())


def sentences_of(text: str) -> list[str]:
    """The sentences of a text as the scan sees them (ASCII letters and digits in lower case)."""
    return [s for s in (normal(x) for x in re.split(BREAK, text.lower())) if s]


def _tables() -> tuple[list[str], list[tuple[str, tuple[int, ...]]]]:
    known: dict[str, int] = {}
    rules: dict[tuple[int, ...], str] = {}
    number = lambda s: tuple(known.setdefault(x, len(known) + 1) for x in sentences_of(s))
    for spdx, parts in TEXTS.items():
        rules[tuple(i for p in parts for i in number(p))] = spdx
    for spdx, names in NAMES.items():
        for name in names:
            for frame in FRAMES:
                for the in ("the ", ""):
                    rules.setdefault(number(frame.format(the=the, name=name)), spdx)
    for spdx, parts in FURTHER:
        rules[tuple(i for p in parts for i in number(p))] = spdx
    for part in WITH_TEXTS:
        number(part)
    assert all(any(a in s for a in ANCHORS) or re.search(UNDER, s) for s in known)
    return list(known), [(name, ids) for ids, name in rules.items()]


#: Identifier i + 1 is KNOWN[i]; each rule is its licence and its identifiers in order.
KNOWN, RULES = _tables()
#: Words of the longest known sentence: one that is wrapped has at most so many lines.
LONGEST = max(s.count(" ") + 1 for s in KNOWN)
#: Names as they come out of normalising, longer ones first, with the identifier of the sentence that says no more than the name.
NAMED = {n: KNOWN.index(f"licensed under {n}") + 1 for n in sorted({normal(x) for names in NAMES.values() for x in names}, key=lambda n: (-len(n), n))}
_NAME = f"(?:{'|'.join(NAMED)})"
#: A notice inside a longer sentence: names after "under" or an SPDX tag, one or several.
NOTICE = rf"\b(?:(?:licensed|licenced|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?|spdx license identifier )({_NAME}(?: licen[cs]e)?(?: (?:and|or|with) (?:the )?{_NAME}(?: licen[cs]e)?)*)\b"
ONE_NAME = rf"\b({_NAME})\b"


def notices_of(sentence: str) -> list[int]:
    """Identifiers of the licences that a normalised sentence, not known itself, names in notices."""
    return [NAMED[n] for chunk in re.findall(NOTICE, sentence) for n in re.findall(ONE_NAME, chunk)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids (array of the known sentences in order), licenses (array, sorted).

    Sentences are single lines, and lines of one paragraph joined, without comment leaders, from any of them to the end of the sentence;
    joined ones follow its lines. A whole sentence that is not known but names licences in notices ("..., and is released under the MIT
    license, see below") counts as the known sentences that name them. Null and empty texts have no sentence. Whole texts are cut, of any
    length. Ids are carried as they are, null or repeated; other columns are ignored.
    """
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_or_empty(text_col)).alias("t"))
    some = F.contains("t", F.lit("under")) & F.rlike("t", F.lit(UNDER))
    for a in ANCHORS:
        some = F.contains("t", F.lit(a)) | some
    joined = F.regexp_replace(F.translate("t", JOINT, "\x02"), WRAP, JOINT)
    cut = low.select("doc_id", F.when(some, F.split(joined, BREAK_JOINED)).alias("s"))
    clean = lambda x: F.regexp_replace(F.btrim(F.regexp_replace(x, NOISE, " ")), WORD_LEADER, "")
    lines = lambda s: F.filter(F.transform(F.split(s, JOINT), clean), lambda x: x != "")
    # a sentence joined from each of its lines on but the last; one that begins earlier has more words than any known sentence
    joins = lambda x: F.transform(F.sequence(F.greatest(F.lit(1), F.size(x) - LONGEST), F.size(x) - 1), lambda i: F.array_join(F.slice(x, i, F.size(x)), " "))
    said = F.array(*map(F.lit, KNOWN))
    number = lambda s: F.when(s.isin(KNOWN), F.array_position(said, s).cast("int")).otherwise(F.lit(0))
    of_name = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    chunks = lambda s: F.flatten(F.transform(F.regexp_extract_all(s, F.lit(NOTICE), F.lit(1)), lambda c: F.regexp_extract_all(c, F.lit(ONE_NAME), F.lit(1))))
    named = lambda s: F.when((F.contains(s, F.lit(" under ")) | F.startswith(s, F.lit("under ")) | F.contains(s, F.lit("spdx license identifier"))) & ~s.isin(KNOWN), F.transform(chunks(s), lambda n: F.element_at(of_name, n))).otherwise(F.array().cast("array<int>"))
    whole = lambda x: F.array_join(x, " ")
    of_sentence = lambda x: F.concat(F.filter(F.concat(F.transform(x, number), F.when(F.size(x) > 1, F.transform(joins(x), number)).otherwise(F.array().cast("array<int>"))), lambda i: i > 0), named(whole(x)))
    ids = cut.select("doc_id", F.transform("s", lines).alias("s")).select("doc_id", F.coalesce(F.flatten(F.transform("s", of_sentence)), F.array().cast("array<int>")).alias("sentence_ids"))
    seq = ids.withColumn("seq", F.concat(F.lit(","), F.array_join(F.col("sentence_ids").cast("array<string>"), ","), F.lit(",")))
    # one sentence: the rule is the sentence; more: their identifiers one after the other
    single = {ids_[0]: name for name, ids_ in RULES if len(ids_) == 1}
    longer = [(name, "," + ",".join(map(str, ids_)) + ",") for name, ids_ in RULES if len(ids_) > 1]
    names = F.array(*(F.lit(single.get(i + 1)) for i in range(len(KNOWN))))
    by_one = F.filter(F.transform("sentence_ids", lambda i: F.get(names, i - 1)), lambda x: x.isNotNull())
    by_more = F.filter(F.array(*(F.when(F.contains("seq", F.lit(p)), F.lit(n)) for n, p in longer)), lambda x: x.isNotNull())
    found = seq.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.concat(by_one, by_more)))).otherwise(F.array().cast("array<string>")).alias("l"))
    for part, whole in INSIDE.items():
        found = found.withColumn("l", F.when(F.array_contains("l", whole), F.array_remove("l", part)).otherwise(F.col("l")))
    return found.select("doc_id", "sentence_ids", F.col("l").alias("licenses"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's rows with the arrays joined by commas."""
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


_q = lambda s: "'" + s.replace("'", "''") + "'"
_K = ", ".join(f"({i + 1}, {_q(s)})" for i, s in enumerate(KNOWN))
_R = ", ".join(f"({_q(name)}, ',{','.join(map(str, ids))},')" for name, ids in RULES)
_I = " OR ".join(f"(name = {_q(p)} AND list_contains(names, {_q(w)}))" for p, w in INSIDE.items())
_N = ", ".join(f"({_q(n)}, {i})" for n, i in NAMED.items())
#: Lines that go on are found line by line, so no look-ahead is needed; a paragraph's lines are put together, and cut at its marks.
ORACLE = rf"""
WITH k(id, s) AS (VALUES {_K}), r(name, pat) AS (VALUES {_R}), nm(name, id) AS (VALUES {_N}),
l0 AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(replace(lower(coalesce(text, '')), chr(1), chr(2)), chr(10)) AS x FROM documents)),
l1 AS (SELECT *, regexp_replace(line, '^[\x20\t]*(?:{LEADER.replace("'", "''")}[\x20\t]*)?', '') AS rest FROM l0),
l2 AS (SELECT *, i > 1 AND NOT (regexp_full_match(rest, '[\x20\t\r]*') AND i < max(i) OVER (PARTITION BY doc_id)) AND NOT regexp_matches(rest, '^\(?(?:[a-z]|[0-9]{{1,2}})[.)][\x20\t]') AS goes_on FROM l1),
l3 AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM l2),
g0 AS (SELECT doc_id, para, string_agg(CASE WHEN goes_on THEN rest ELSE line END, chr(1) ORDER BY i) AS t FROM l3 GROUP BY ALL),
g1 AS (SELECT doc_id, para, unnest(x) AS part, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, para, regexp_split_to_array(t, '[.!?](?:[\x20\t\r\x01]+|$)') AS x FROM g0)),
g2 AS (SELECT doc_id, para, j, list_filter(list_transform(string_split(part, chr(1)), lambda x: regexp_replace(trim(regexp_replace(x, '{NOISE}', ' ', 'g')), '{WORD_LEADER}', '')), lambda x: x <> '') AS x FROM g1),
c0 AS (SELECT doc_id, para, j, array_to_string(x, ' ') AS whole, list_concat(x, list_transform(range(greatest(1, len(x) - {LONGEST}), len(x)), lambda a: array_to_string(x[a:], ' '))) AS c FROM g2 WHERE len(x) > 0),
c1 AS (SELECT doc_id, para, j, unnest(c) AS s, generate_subscripts(c, 1) AS n FROM c0),
n0 AS (SELECT doc_id, para, j, unnest(x) AS chunk, generate_subscripts(x, 1) AS a FROM (SELECT doc_id, para, j, regexp_extract_all(whole, '{NOTICE}', 1) AS x FROM c0 WHERE whole NOT IN (SELECT s FROM k))),
n1 AS (SELECT doc_id, para, j, a, unnest(x) AS name, generate_subscripts(x, 1) AS b FROM (SELECT doc_id, para, j, a, regexp_extract_all(chunk, '{ONE_NAME}', 1) AS x FROM n0)),
u AS (SELECT doc_id, para, j, 0 AS kind, n AS a, 0 AS b, id FROM c1 JOIN k USING (s) UNION ALL SELECT doc_id, para, j, 1, a, b, id FROM n1 JOIN nm USING (name)),
h AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY para, j, kind, a, b) AS ids, count(*) AS n FROM u GROUP BY doc_id),
m AS (SELECT DISTINCT doc_id, name FROM h JOIN r ON contains(',' || ids || ',', pat)),
g AS (SELECT *, list(name) OVER (PARTITION BY doc_id) AS names FROM m),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM g WHERE NOT ({_I}) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""

QUERIES = {"op5_license_scan": op5}
ORACLES = {"op5_license_scan": ORACLE}
