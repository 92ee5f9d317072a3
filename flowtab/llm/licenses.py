"""License scans by sentence rules.

A text is cut into sentences at sentence ends and blank lines (a single line end is a wrap, and joins); each is normalised (small
letters, signs to single spaces) and mapped to the identifiers of the known licence sentences that stand in it. The
identifiers, in the order of the text, are then matched against ordered rules: a rule fits where its identifiers stand in that
order, others may stand between. A rule hides those whose wording is part of its own (``HIDES``).

Known are the telling sentences of public licence texts and headers (``SENTENCES``), and notices made from names by a rule
(``NAMES``): "under", "under the" or "under the terms of the" and the name.

All of it is expressions over the row, so nothing is shuffled; only sentences with a word that known ones have are looked at
(``ANCHORS``, each known sentence has one), and texts without any are not cut at all.

Edge cases. Null and empty texts match nothing. Very long texts are cut whole, in time linear in them. Sentences said twice are listed
twice; of several known in one sentence (ties) the order is that of the table. Repeated rows get equal rows. An empty table gives an
empty result. Only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and headers, or the part of one that holds no name, by identifier.
_TEXTS = {
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-grant": "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    "apache-2.0-use": "you may not use this file except in compliance with the License",
    "apache-2.0-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-and-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "gpl-2-title": "GNU General Public License Version 2, June 1991",
    "gpl-3-title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl-3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl-3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gnu-version-2": "either version 2 of the License",
    "gnu-version-2.1": "either version 2.1 of the License",
    "gnu-version-3": "either version 3 of the License",
    "gnu-warranty": "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "mpl-2.0-place": "You can obtain one at http://mozilla.org/MPL/2.0",
    "mpl-2.0-secure": "You can obtain one at https://mozilla.org/MPL/2.0",
    "mpl-2.0-grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license",
    "cc0-1.0-title": "CC0 1.0 Universal",
    "cc0-1.0-purpose": "voluntarily elects to apply CC0 to the Work and publicly distribute the Work under its terms",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-freedom": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "reserved": "All rights reserved",
}
#: Names of licences in notices.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "GNU GPL version 2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "GNU GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3"],
    "AGPL-3.0": ["GNU Affero General Public License version 3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "CC0-1.0": ["CC0 1.0"],
    "Unlicense": ["Unlicense"],
}
#: Further licences that are known by their identifier in a file's tag alone.
TAGGED = ["0BSD", "Artistic-2.0", "BSL-1.0", "CC-BY-3.0", "CC-BY-SA-3.0", "EPL-2.0", "Zlib"]
_CC = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_CC_KINDS = ["BY", "BY-NC", "BY-ND", "BY-SA", "BY-NC-ND", "BY-NC-SA"]
_UNDER = ["under", "under the", "under the terms of the"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    """Small letters and digits, all else as single spaces."""
    return re.sub("[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip()


def _table() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Known sentences by identifier, and rules: licence, its identifiers in order."""
    known = {k: normal(v) for k, v in _TEXTS.items()}
    rules = [
        ("Apache-2.0", ["apache-2.0-title", "apache-2.0-grant"]), ("Apache-2.0", ["apache-2.0-use", "apache-2.0-basis"]),
        ("MIT", ["mit-grant", "mit-condition"]), ("MIT", ["mit-condition", "mit-warranty"]),
        ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
        ("ISC", ["isc-grant", "isc-warranty"]), ("ISC", ["isc-and-grant", "isc-warranty"]),
        ("GPL-2.0", ["gpl-2-title"]), ("GPL-2.0", ["gpl-terms", "gnu-version-2", "gnu-warranty"]),
        ("GPL-3.0", ["gpl-3-title"]), ("GPL-3.0", ["gpl-terms", "gnu-version-3", "gnu-warranty"]),
        ("LGPL-2.1", ["lgpl-2.1-title"]), ("LGPL-2.1", ["lgpl-terms", "gnu-version-2.1", "gnu-warranty"]),
        ("LGPL-3.0", ["lgpl-3-title"]), ("LGPL-3.0", ["lgpl-terms", "gnu-version-3", "gnu-warranty"]),
        ("AGPL-3.0", ["agpl-3-title"]), ("AGPL-3.0", ["agpl-terms", "gnu-version-3", "gnu-warranty"]),
        ("MPL-2.0", ["mpl-2.0-title", "mpl-2.0-grant"]), ("MPL-2.0", ["mpl-2.0-header", "mpl-2.0-place"]), ("MPL-2.0", ["mpl-2.0-header", "mpl-2.0-secure"]),
        ("CC0-1.0", ["cc0-1.0-title", "cc0-1.0-purpose"]), ("Unlicense", ["unlicense-domain", "unlicense-freedom"]),
        ("All-Rights-Reserved", ["reserved"]),
    ]
    names = dict(NAMES)
    for kind in _CC_KINDS:
        spelt = "-".join(_CC[p] for p in kind.split("-"))
        names[f"CC-{kind}-4.0"] = [f"CC {kind} 4.0", f"Creative Commons {spelt} 4.0 International License"]
        code = f"cc-{kind.lower()}-4.0-code"
        known[code] = normal(f"Creative Commons {spelt} 4.0 International Public License")
        rules.append((f"CC-{kind}-4.0", [code]))
    for licence in [*names, *TAGGED]:
        key = f"{licence.lower()}-tag"
        known[key] = normal(f"SPDX-License-Identifier: {licence}")
        rules.append((licence, [key]))
    for licence, spellings in names.items():
        for i, name in enumerate(spellings):
            for j, under in enumerate(_UNDER):
                key = f"{licence.lower()}-notice-{i}{j}"
                known[key] = normal(f"{under} {name}")
                rules.append((licence, [key]))
    return known, rules


SENTENCES, RULES = _table()
#: Permissive licences may be trained on in most settings; the others ask for a decision.
PERMISSIVE = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC0-1.0", "ISC", "MIT", "Unlicense", "Zlib"]
#: (licence, those that are no finding of their own beside it): a copyright line goes before a grant of rights, and does not take it back.
HIDES = [("BSD-3-Clause", ["BSD-2-Clause"]), *((name, ["All-Rights-Reserved"]) for name in PERMISSIVE)]
ANCHORS = ["licens", "warrant", "redistribut", "hereby granted", "permission notice", "endorse", "cc by", "cc0", "rights reserved", "public domain", "obtain one at", "anyone is free", "gnu gpl"]
#: Sentence ends before white space, and blank lines.
_CUT = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"
_ANCHOR = "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)


def _pattern(ids: list[str]) -> str:
    return "," + ",(?:.*,)?".join(i.replace(".", "[.]") for i in ids) + ","


def sentences(text: Column) -> Column:
    """Normalised sentences, in order."""
    small = F.translate(text, _UPPER, _LOWER)
    return F.transform(F.split(small, _CUT), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def scan(df: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, permissive`` for every row."""
    known = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(f" {v} ").alias("words")) for k, v in SENTENCES.items()))
    telling = F.transform(F.filter(sentences(F.col("text")), lambda s: s.rlike(_ANCHOR)), lambda s: F.concat(F.lit(" "), s, F.lit(" ")))
    each = F.flatten(F.transform(telling, lambda s: F.transform(F.filter(known, lambda k: F.contains(s, k["words"])), lambda k: k["id"])))
    ids = F.when(F.translate("text", _UPPER, _LOWER).rlike(_ANCHOR), each)
    found = df.select("doc_id", "text").select("doc_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    spelt = found.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    padded = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    # Texts without any known sentence, nearly all, are matched against no rule.
    hits = F.when(F.col("n_sentences") > 0, F.array(*(F.when(padded.rlike(_pattern(ids)), F.lit(name)) for name, ids in RULES)))
    licenses = F.array_distinct(F.array_compact(F.coalesce(hits, F.array().cast("array<string>"))))
    hidden = F.flatten(F.array(*(F.when(F.array_contains("l", name), F.array(*map(F.lit, gone))).otherwise(F.array().cast("array<string>")) for name, gone in HIDES)))
    allowed = F.array(*map(F.lit, PERMISSIVE))
    return spelt.withColumn("l", licenses).withColumn("l", F.array_sort(F.array_except("l", hidden))).select(
        "doc_id", "n_sentences", "sentence_ids", F.array_join("l", ",").alias("licenses"),
        ((F.size("l") > 0) & (F.size(F.array_except("l", allowed)) == 0)).alias("permissive"),
    )


_lit = lambda s: "'" + s.replace("'", "''") + "'"
SQL = f"""
WITH known(id, words, ord) AS (VALUES {", ".join(f"({_lit(k)}, {_lit(f' {v} ')}, {i})" for i, (k, v) in enumerate(SENTENCES.items()))}),
rules(name, pattern) AS (VALUES {", ".join(f"({_lit(n)}, {_lit(_pattern(i))})" for n, i in RULES)}),
hides(name, gone) AS (VALUES {", ".join(f"({_lit(n)}, {_lit(g)})" for n, gs in HIDES for g in gs)}),
parts AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.!?]+[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n') AS p FROM documents),
s AS (SELECT doc_id, i, ' ' || trim(regexp_replace(p[i], '[^a-z0-9]+', ' ', 'g')) || ' ' AS sentence FROM parts, UNNEST(range(1, len(p) + 1)) AS u(i)),
f AS (SELECT s.doc_id, count(*) AS n, string_agg(known.id, ',' ORDER BY i, ord) AS ids FROM s JOIN known ON contains(s.sentence, known.words) GROUP BY s.doc_id),
h AS (SELECT DISTINCT doc_id, name FROM f, rules WHERE regexp_matches(',' || ids || ',', pattern)),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, bool_and(name IN ({", ".join(map(_lit, PERMISSIVE))})) AS permissive
      FROM h WHERE NOT EXISTS (SELECT 1 FROM h b JOIN hides ON b.name = hides.name WHERE b.doc_id = h.doc_id AND hides.gone = h.name) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses, coalesce(permissive, false) AS permissive
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""
