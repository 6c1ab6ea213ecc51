"""Licence recognition by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than a-z and 0-9 become one blank) with its line ends kept, and
cut after . ! ? ; before a blank, at lines without letters or digits, at URLs (which may end a sentence), at dashes between
blanks and before ", see". A known licence sentence is found where it fills one or more whole lines of such a part, so
wrapped sentences are found as well as those on one line, and where a line starts within another's, the longer is taken.
Each is mapped to its number. A rule is an ordered list of such numbers; it matches where its numbers follow one another
among the text's known sentences with at most GAP unknown lines or sentences between two of them, where one of more than
PIECE characters counts once more for each further PIECE. Rules are the licences' own notices (RULES), their names in
statements of use (FORMS) and their SPDX tags; of an SPDX expression with AND, OR or WITH nothing is found.

Defined cases: null and empty texts have no sentences; rows are independent, so null and repeated ids are kept; sentences
repeated in a row count each; where a rule's sentences stand within those of a longer rule that matches, only the longer
one counts; long texts are matched whole, by patterns that scan each stretch once; an empty table gives an empty result.
Only the id and text column are read, so others never clash. Nothing is joined or shuffled: the sentences are a literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import table

#: Rules with their sentences, as the licences' own notices write them.
RULES = {
    "Apache-2.0": [["Licensed under the Apache License, Version 2.0."], ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License."]],
    "MIT": [["Released under the MIT License."], ["Licensed under the MIT License."], ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]],
    "ISC": [["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."], ["Released under the ISC License."]],
    "BSD-2-Clause": [["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."], ["Licensed under the BSD 2-Clause License."]],
    "BSD-3-Clause": [["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."], ["Licensed under the BSD 3-Clause License."]],
    "GPL-2.0": [["This work is licensed under the GNU General Public License, version 2."], ["This program is free software;", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;", "either version 2 of the License, or (at your option) any later version."]],
    "GPL-3.0": [["This work is licensed under the GNU General Public License, version 3."], ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]],
    "LGPL-3.0": [["This work is licensed under the GNU Lesser General Public License, version 3."]],
    "AGPL-3.0": [["This work is licensed under the GNU Affero General Public License, version 3."]],
    "MPL-2.0": [["This Source Code Form is subject to the terms of the Mozilla Public License, v.", "2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"], ["Licensed under the Mozilla Public License, version 2.0."]],
    "CC-BY-4.0": [["Licensed under CC BY 4.0."], ["This work is licensed under a Creative Commons Attribution 4.0 International License."]],
    "CC-BY-SA-4.0": [["Licensed under CC BY-SA 4.0."], ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]],
    "CC-BY-NC-4.0": [["Licensed under CC BY-NC 4.0."], ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]],
    "CC0-1.0": [["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."], ["Released under CC0 1.0."]],
    "Unlicense": [["This is free and unencumbered software released into the public domain."]],
    "Proprietary": [["All rights reserved."]],
    "LGPL-2.1": [["This library is free software;", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;", "either version 2.1 of the License, or (at your option) any later version."]],
    "Zlib": [["This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software."]],
    "BSL-1.0": [["Distributed under the Boost Software License, Version 1.0."]],
    "0BSD": [["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."]],
    "EPL-2.0": [["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"]],
    "OFL-1.1": [["This Font Software is licensed under the SIL Open Font License, Version 1.1."]],
    "CDDL-1.0": [["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "You may not use this file except in compliance with the License."]],
}
#: Further notices of the licences above.
MORE_RULES = {
    "LGPL-3.0": [["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]],
    "AGPL-3.0": [["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]],
}
#: SPDX identifiers and names by which statements of use call them.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU AGPLv3"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0 Universal License"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "ECL-2.0": ["Educational Community License 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["PostgreSQL License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL License"],
    "Zlib": ["zlib License"],
}
FORMS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "This work is licensed under a {}", "This code is released under the {}")
TAGS = ("SPDX-License-Identifier: {}", "SPDX-License-Identifier: {}-only", "SPDX-License-Identifier: {}-or-later", "SPDX-License-Identifier: {}+")
GAP, PIECE = 5, 200


def variants() -> Iterator[tuple[str, list[str]]]:
    """Every rule: a licence and its sentences."""
    for rules in (RULES, MORE_RULES):
        yield from ((name, sentences) for name, every in rules.items() for sentences in every)
    for name, titles in NAMES.items():
        yield from ((name, [form.format(title)]) for title in titles for form in FORMS)
        yield from ((name, [tag.format(name)]) for tag in (TAGS if "GPL" in name else TAGS[:1]))


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def numbered() -> tuple[list[str], list[tuple[str, list[int]]]]:
    """The known sentences, numbered from 1 by place, and the rules in their numbers."""
    known: dict[str, int] = {}
    rules: list[tuple[str, list[int]]] = []
    for name, sentences in variants():
        rule = (name, [known.setdefault(normal(s), len(known) + 1) for s in sentences])
        if rule not in rules:
            rules.append(rule)
    return list(known), rules


def marks(ids: Sequence[int]) -> str:
    """A pattern of sentence numbers as they stand in a trail, where a dot is an unknown line or sentence."""
    return f"\\.{{0,{GAP}}}".join(f",{i}," for i in ids)


def longer(rules: list[tuple[str, list[int]]], ids: list[int]) -> list[tuple[int, ...]]:
    """The rules' sequences, longest first, that hold ids and more."""
    within = lambda seq: any(seq[k : k + len(ids)] == ids for k in range(len(seq)))
    return sorted({tuple(seq) for _, seq in rules if len(seq) > len(ids) and within(seq)}, key=len, reverse=True)


#: Each known sentence holds one of these, without blanks between words, whatever these are in the text: texts without any are passed over.
WORDS = "licen|permission|redistribut|copyright|software|contributors|mpl|reserved|cc0|gplv|2[^a-z0-9]+0"
CUT = "\u0001"
#: Where a sentence may end besides its stop.
ENDS = "(https?://|www\\.)[^ \\t\\r\\n]+|[ \\t][-\u2013\u2014]+[ \\t]|,[ \\t\\r\\n]+see[ \\t\\r\\n]"


def normal_lines(text: Column) -> Column:
    """The text in normal form, its lines parted by a line end and its parts by CUT. No pattern scans a stretch more than once."""
    out = F.translate(F.lower(text), CUT, "|")
    for pattern, by in ((ENDS, CUT), ("[.!?;][ \\t\\r\\n]+", CUT), (f"[^a-z0-9\\n{CUT}]+", " "), (" ?\\n ?", "\n"), ("\\n\\n+", CUT), (f" ?\\n?{CUT}[ \\n{CUT}]*", CUT)):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def license_findings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (array of int, in text order), licenses (array of names, sorted) of rows with a known sentence."""
    known, rules = numbered()
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.filter(F.lower("text").rlike(WORDS))
    numbers = F.create_map(*(x for i, s in enumerate(known, 1) for x in (F.lit(s), F.lit(i))))
    longest = sorted(known, key=len, reverse=True)
    whole = "(?<![a-z0-9 ])(?:" + "|".join(x.replace(" ", "[ \\n]") for x in longest) + ")(?![a-z0-9 ])"
    # every line is met once: as (part of) a known sentence or as an unknown piece, whose number is null
    pieces = F.regexp_extract_all(normal_lines(F.col("text")), F.lit(f"{whole}|[^\\n{CUT}]+"), F.lit(0))
    met = F.transform(pieces, lambda s: F.struct(F.element_at(numbers, F.translate(s, "\n", " ")).alias("id"), F.length(s).alias("n")))
    found = rows.select("doc_id", met.alias("met")).filter(F.exists("met", lambda x: x["id"].isNotNull()))
    mark = lambda x: F.coalesce(F.concat(F.lit(","), x["id"].cast("string"), F.lit(",")), F.repeat(F.lit("."), F.floor(x["n"] / PIECE).cast("int") + 1))
    trail = F.regexp_replace(F.array_join(F.transform("met", mark), ""), f"\\.{{{GAP + 1},}}", "-")
    ids = F.filter(F.transform("met", lambda x: x["id"]), lambda x: x.isNotNull())
    found = found.select("doc_id", ids.alias("sentence_ids"), trail.alias("trail"))

    def matched(ids: list[int]) -> Column:
        left = F.col("trail")
        for seq in longer(rules, ids):
            left = F.regexp_replace(left, marks(seq), "-")
        return left.rlike(marks(ids))

    # a rule of one sentence that is in no longer rule matches wherever its number is
    lone = {seq[0]: name for name, seq in rules if len(seq) == 1 and not longer(rules, seq)}
    names = F.create_map(*(F.lit(x) for pair in lone.items() for x in pair))
    hits = F.array(*(F.when(matched(seq), F.lit(name)) for name, seq in rules if lone.get(seq[0]) != name or len(seq) > 1))
    every = F.concat(hits, F.transform("sentence_ids", lambda i: F.element_at(names, i)))
    return found.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.array_compact(every))).alias("licenses"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    known, rules = numbered()
    values = ", ".join(f"('{s}', {i})" for i, s in enumerate(known, 1))

    def left(ids: list[int]) -> str:
        out = "trail"
        for seq in longer(rules, ids):
            out = f"regexp_replace({out}, '{marks(seq)}', '-', 'g')"
        return out

    cases = ", ".join(f"CASE WHEN regexp_matches({left(seq)}, '{marks(seq)}') THEN '{name}' END" for name, seq in rules)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
ended AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '{ENDS}', chr(10), 'g') AS text FROM documents),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM ended),
flat AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut),
pieces AS (SELECT doc_id, place, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS piece FROM flat),
numbered AS (SELECT doc_id, place, id, CASE WHEN id IS NULL THEN repeat('.', 1 + length(piece) // {PIECE}) ELSE ',' || id || ',' END AS mark FROM pieces LEFT JOIN known ON piece = sentence WHERE piece <> ''),
marked AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (id IS NOT NULL) AS sentence_ids, regexp_replace(string_agg(mark, '' ORDER BY place), '\\.{{{GAP + 1},}}', '-', 'g') AS trail FROM numbered WHERE doc_id IN (SELECT doc_id FROM numbered WHERE id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ',') AS licenses FROM marked
"""


OP7_SQL = _oracle()
