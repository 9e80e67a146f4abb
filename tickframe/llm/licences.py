"""Licence scan by sentence rules: known sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, in normal form (lower case, letters and digits only).
SENTENCES = {
    "ApacheBy": ("licensed under the apache license version 2 0",
                 "licensed under the apache license version 2 0 the license"),
    "ApacheUse": ("you may not use this file except in compliance with the license",),
    "ApacheCopy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",
                   "you may obtain a copy of the license at https www apache org licenses license 2 0",
                   "you may obtain a copy of the license at"),
    "ApacheAsIs": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
                   "an as is basis without warranties or conditions of any kind either express or implied",),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "MitBy": ("released under the mit license", "licensed under the mit license", "the mit license", "mit license"),
    "MitGrant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                 "documentation files the software to deal in the software without restriction including without limitation the rights to "
                 "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
                 "software is furnished to do so subject to the following conditions",),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
                  "software",),
    "MitAsIs": ("the software is provided as is without warranty of any kind express or implied including but not limited to the "
                "warranties of merchantability fitness for a particular purpose and noninfringement",),
    "GplBy": ("this work is licensed under the gnu general public license version 3",
              "licensed under the gnu general public license version 3"),
    "GplFree3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
                 "as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GplFree2": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
                 "as published by the free software foundation either version 2 of the license or at your option any later version",),
    "GplHope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
                "of merchantability or fitness for a particular purpose",),
    "GplSee": ("see the gnu general public license for more details",),
    "BsdRedist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
                  "following conditions are met",),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",),
    "BsdBinary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                  "disclaimer in the documentation and or other materials provided with the distribution",),
    "BsdNames": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                 "derived from this software without specific prior written permission",),
    "LgplFree21": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
                   "license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "LgplFree3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
                  "license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "LgplHope": ("this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
                 "of merchantability or fitness for a particular purpose",),
    "LgplSee": ("see the gnu lesser general public license for more details",),
    "AgplFree3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
                  "license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "AgplSee": ("see the gnu affero general public license for more details",),
    "IscGrant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
                 "that the above copyright notice and this permission notice appear in all copies",
                 "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided "
                 "that the above copyright notice and this permission notice appear in all copies"),
    "EplBy": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
              "available at https www eclipse org legal epl 2 0",
              "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
              "available at http www eclipse org legal epl 2 0",
              "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
              "available at", "licensed under the eclipse public license 2 0"),
    "ZlibAsIs": ("this software is provided as is without any express or implied warranty",),
    "ZlibGrant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
                  "and redistribute it freely subject to the following restrictions",),
    "BslBy": ("distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0"),
    "ArtisticBy": ("this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
                   "licensed under the artistic license 2 0"),
    "MplA": ("this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license 2 0"),
    "CcBy": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CcBySa": ("licensed under cc by sa 4 0",),
    "CcByNc": ("licensed under cc by nc 4 0",),
    "CcByNd": ("licensed under cc by nd 4 0",),
    "Cc0": ("licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related rights"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "Reserved": ("all rights reserved",),
}
#: Licences that a tag line may name.
TAGGED = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0",
          "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
          "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"Tag:{name}": ("spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower())),) for name in TAGGED}
#: Licence rules in order: the first that fits takes its identifiers, so longer sequences come first.
RULES = (
    ("Apache-2.0", "ApacheBy ApacheUse ApacheCopy ApacheAsIs ApacheSee"), ("Apache-2.0", "ApacheBy ApacheUse ApacheCopy"),
    ("Apache-2.0", "ApacheBy"), ("MIT", "MitBy MitGrant MitNotice MitAsIs"), ("MIT", "MitGrant MitNotice MitAsIs"),
    ("MIT", "MitGrant MitNotice"), ("MIT", "MitBy"), ("GPL-3.0-or-later", "GplFree3 GplHope GplSee"), ("GPL-3.0-or-later", "GplFree3"),
    ("GPL-2.0-or-later", "GplFree2 GplHope GplSee"), ("GPL-2.0-or-later", "GplFree2"), ("GPL-3.0-only", "GplBy"),
    ("BSD-3-Clause", "BsdRedist BsdSource BsdBinary BsdNames"), ("BSD-2-Clause", "BsdRedist BsdSource BsdBinary"),
    ("MPL-2.0", "MplA"), ("CC-BY-NC-4.0", "CcByNc"), ("CC-BY-SA-4.0", "CcBySa"), ("CC-BY-ND-4.0", "CcByNd"), ("CC-BY-4.0", "CcBy"),
    ("CC0-1.0", "Cc0"), ("Unlicense", "Unlicense"), ("LicenseRef-all-rights-reserved", "Reserved"),
    ("LGPL-2.1-or-later", "LgplFree21 LgplHope LgplSee"), ("LGPL-2.1-or-later", "LgplFree21"),
    ("LGPL-3.0-or-later", "LgplFree3 GplHope LgplSee"), ("LGPL-3.0-or-later", "LgplFree3"),
    ("AGPL-3.0-or-later", "AgplFree3 GplHope AgplSee"), ("AGPL-3.0-or-later", "AgplFree3"),
    ("ISC", "IscGrant"), ("EPL-2.0", "EplBy"), ("Zlib", "ZlibAsIs ZlibGrant"), ("Zlib", "ZlibGrant"),
    ("BSL-1.0", "BslBy"), ("Artistic-2.0", "ArtisticBy"), *((name, f"Tag:{name}") for name in TAGGED),
)
#: Every known sentence holds one of these single words, which wrapped lines and comment signs leave whole; other sentences need no normal form.
KEYWORDS = r"(?i)licen[sc]e|permission|copyright|warrant|redistribut|domain|reserved"
_KNOWN = [(s, k) for k, group in SENTENCES.items() for s in group]
_MARK = "\x1e"
#: Where sentences end, as (pattern, what stays before the cut, after it), in this order.
_CUTS = (
    (r"(?im)^([^A-Za-z0-9\n]*copyright[ \t]*(?:\(c\)|[0-9])[^\n]*)\n", "1", ""),  # a copyright line
    (r"(https?://[^ \t\r\n]+)[ \t\r\n]+", "1", ""),
    (r"([.!?])[ \t\r\n]+", "1", ""),
    (r"([a-z]):[ \t\r\n]+([A-Z0-9])", "1", "2"),
    (r"\n[^A-Za-z0-9\n]*\n", "", ""),  # an empty line, or one with comment signs only
)
_TAG, _CLAUSE, _ASIDE = r"(?i)(SPDX-License-Identifier):[ \t]*", r";[ \t\r\n]+", r"\([^()]*\)"


def _normal(s: Column) -> Column:
    """Letters and digits in lower case with single blanks between; comment signs and wrapped lines vanish."""
    return F.trim(F.regexp_replace(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _known(s: Column) -> Column:
    """The identifier of a sentence, as it stands or without what is in parentheses; null if it is not a known one."""
    def named(text: Column) -> Column:
        place = F.array_position(F.array(*[F.lit(t) for t, _ in _KNOWN]), _normal(text)).cast("int")
        return F.when(place > 0, F.get(F.array(*[F.lit(k) for _, k in _KNOWN]), place - 1))
    return F.coalesce(named(s), named(F.regexp_replace(s, _ASIDE, " ")))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, rest) for each row of ``docs``.

    Sentences end at a full stop, exclamation or question mark before white space, after an address, at a colon before a
    capital letter or digit, around a copyright line, and at an empty line or one of comment signs.  One that is not known as a
    whole, nor without its parentheses, is tried clause by clause (up to semicolons), and such a clause line by line.  ``sentence_ids``
    are the identifiers of the known ones in text order.  Rules are tried in order: one
    that finds its identifiers side by side adds its licence and uses up all such runs.
    ``rest`` are the identifiers no rule used.  Null and empty texts have no
    sentences and no licences (empty strings); repeated rows are judged alike; an empty
    table gives no rows; other columns are ignored.  A row is handled on its own: no shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = F.regexp_replace(text, _TAG, "$1 ")
    for pattern, before, after in _CUTS:
        cut = F.regexp_replace(cut, pattern, (f"${before}" if before else "") + _MARK + (f"${after}" if after else ""))
    telling = lambda s: s.rlike(KEYWORDS)
    either = lambda s, parts: F.coalesce(F.when(_known(s).isNotNull(), F.array(_known(s))), parts)
    by_line = lambda s: F.filter(F.transform(F.filter(F.split(s, "\n"), telling), _known), lambda k: k.isNotNull())
    by_clause = lambda s: F.flatten(F.transform(F.filter(F.split(s, _CLAUSE), telling), lambda c: either(c, by_line(c))))
    ids = F.flatten(F.transform(F.filter(F.split(cut, _MARK), telling), lambda s: either(s, by_clause(s))))
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.when(text.rlike(KEYWORDS), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    rules = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(f" {' '.join(s.split())} ").alias("run")) for k, s in RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("seq"), F.array().cast("array<string>").alias("hit"))
    doubled = lambda r: F.replace(F.trim(r["run"]), F.lit(" "), F.lit("  "))

    def apply(state: Column, rule: Column) -> Column:
        run = F.concat(F.lit(" "), doubled(rule), F.lit(" "))
        return F.struct(F.replace(state["seq"], run, F.lit("")).alias("seq"),
                        F.when(F.contains(state["seq"], run), F.concat(state["hit"], F.array(rule["name"]))).otherwise(state["hit"]).alias("hit"))

    done = found.select("doc_id", "ids", F.aggregate(rules, start, apply).alias("d"))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"),
                       F.array_join(F.array_sort(F.array_distinct("d.hit")), " ").alias("licences"),
                       F.trim(F.regexp_replace("d.seq", " +", " ")).alias("rest"))


def _oracle() -> str:
    known = "[" + ", ".join(f"'{t}'" for t, _ in _KNOWN) + "]"
    names = "[" + ", ".join(f"'{k}'" for _, k in _KNOWN) + "]"
    normal = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    one = lambda x: f"list_extract({names}, list_position({known}, {normal.format(x)}))"
    id_ = lambda x: f"coalesce({one(x)}, {one(f"regexp_replace({x}, '{_ASIDE}', ' ', 'g')")})"
    lines = f"list_filter(list_transform(string_split(c, chr(10)), lambda l: {id_('l')}), lambda k: k IS NOT NULL)"
    clauses = (f"flatten(list_transform(regexp_split_to_array(s, '{_CLAUSE}'), "
               f"lambda c: CASE WHEN {id_('c')} IS NOT NULL THEN [{id_('c')}] ELSE {lines} END))")
    cut = f"regexp_replace(coalesce(text, ''), '{_TAG}', '\\1 ', 'g')"
    for pattern, before, after in _CUTS:
        cut = f"regexp_replace({cut}, '{pattern}', '{f'\\{before}' if before else ''}' || chr(30) || '{f'\\{after}' if after else ''}', 'g')"
    body = f"""SELECT doc_id, flatten(list_transform(string_split({cut}, chr(30)),
        lambda s: CASE WHEN {id_('s')} IS NOT NULL THEN [{id_('s')}] ELSE {clauses} END)) AS ids FROM documents"""
    sql = (f"SELECT doc_id, ids, ' ' || coalesce(array_to_string(ids, '  '), '') || ' ' AS seq, CAST([] AS VARCHAR[]) AS hit FROM ({body})")
    for name, run in RULES:
        spaced = " " + "  ".join(run.split()) + " "
        sql = (f"SELECT doc_id, ids, replace(seq, '{spaced}', '') AS seq, CASE WHEN contains(seq, '{spaced}') "
               f"THEN list_append(hit, '{name}') ELSE hit END AS hit FROM ({sql})")
    return (f"SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, "
            f"coalesce(array_to_string(list_sort(list_distinct(hit)), ' '), '') AS licences, "
            f"trim(regexp_replace(seq, ' +', ' ', 'g')) AS rest FROM ({sql})")


ORACLE = _oracle()
