"""Operator 7, licence scans: sentences to identifiers, identifier sequences against ordered rules.

Plain DataFrame functions throughout. A text's sentences (line ends and sentence ends part them; a line that begins with a
small letter goes on the one before) are normalised to lower-case words, with spellings that mean the same made one, and
looked up among known licence sentences. The identifiers found, in order, are matched against the rules: a rule is a
sequence of identifiers that must follow one another among those found. Rules are tried in their order, longer sequences
first; what a rule matches is taken out of the sequence, so no later rule sees it: the three clauses of a BSD-3-Clause text
are not a BSD-2-Clause one too. A mark stays in its place, so what stood on either side of it does not follow one another. Rules without a name take sentences that say nothing by themselves, as disclaimers do.
Every known sentence holds a trigger word, so texts without any are not cut up at all.

Defined cases: a null or empty text has no sentences and no licences; a rule met twice counts once; licences are listed in
the alphabet's order; repeated rows give a row each; null ids are kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "agpl3-ref": "this work is licensed under the gnu affero general public license version 3",
    "apache2-distributed": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2-ref": "licensed under the apache license version 2 0",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-ref": "released under the bsd license",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-nc-4-ref": "licensed under cc by nc 4 0",
    "cc-by-4-ref": "licensed under cc by 4 0",
    "cc-by-sa-4-ref": "licensed under cc by sa 4 0",
    "gpl2-ref": "this work is licensed under the gnu general public license version 2",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl3-ref": "this work is licensed under the gnu lesser general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-ref": "released under the mit license",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
# Rules, each a licence and the identifiers that make it, in order.
RULES = [
    ("AGPL-3.0", ["agpl3-ref"]), ("Apache-2.0", ["apache2-grant", "apache2-distributed", "apache2-see"]), ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-ref"]), ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary"]), ("BSD", ["bsd-ref"]),
    ("CC-BY-4.0", ["cc-by-4-ref"]), ("CC-BY-NC-4.0", ["cc-by-nc-4-ref"]), ("CC-BY-SA-4.0", ["cc-by-sa-4-ref"]), ("GPL-2.0", ["gpl2-ref"]),
    ("GPL-3.0", ["gpl3-ref"]), ("LGPL-3.0", ["lgpl3-ref"]), ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-ref"]), ("MPL-2.0", ["mpl2-ref"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]), ("ISC", ["isc-grant"]), ("ISC", ["isc-grant-and"]), ("Zlib", ["zlib-grant"]),
    ("all-rights-reserved", ["reserved"]),
]
# The GNU notice by licence and version. "(at your option) ..." is a sentence of its own where it begins a line.
GNU = [("GPL", "general", "2"), ("GPL", "general", "3"), ("LGPL", "lesser general", "2 1"), ("LGPL", "lesser general", "3"), ("AGPL", "affero general", "3")]
for _short, _long, _version in GNU:
    _name = f"{_short}-{_version.replace(' ', '.') if ' ' in _version else _version + '.0'}-or-later"
    for _what in ("program", "library"):
        for _part, _rest in (("", " at your option any later version"), ("-wrapped", "")):
            _id = f"{_name.lower()}-{_what}{_part}"
            SENTENCES[_id] = f"this {_what} is free software you can redistribute it and or modify it under the terms of the gnu {_long} public license as published by the free software foundation either version {_version} of the license or{_rest}"
            RULES.append((_name, [_id]))
# Licences whose SPDX header line is known.
SPDX = """AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib""".split()
for _name in SPDX:
    SENTENCES[f"spdx-{_name.lower()}"] = "spdx license identifier " + _name.lower().replace("-", " ").replace(".", " ")
    RULES.append((_name, [f"spdx-{_name.lower()}"]))

# More sentences of public licences, and their rules.
SENTENCES |= {
    "apache2-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache2-title-line": "version 2 0 january 2004",
    "as-is-apache": "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holder and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsl1-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl1-title": "boost software license version 1 0 august 17th 2003",
    "cc0-dedication": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl2-grant": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "gnu-received-gpl": "you should have received a copy of the gnu general public license along with this program",
    "gnu-received-lgpl": "you should have received a copy of the gnu lesser general public license along with this library",
    "gnu-see": "see the gnu general public license for more details",
    "gnu-see-lesser": "see the gnu lesser general public license for more details",
    "gnu-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holder be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-title": "do what the fuck you want to public license",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
}
RULES += [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]), ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-title-short", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]), ("MIT", ["mit-title"]), ("MIT", ["mit-title-short"]),
    ("BSD-4-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]), ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse-author"]),
    ("Apache-2.0", ["apache2-grant", "apache2-obtain", "apache2-distributed", "apache2-see"]), ("Apache-2.0", ["apache2-title"]), ("Apache-2.0", ["apache2-title-line"]),
    ("BSL-1.0", ["bsl1-grant"]), ("BSL-1.0", ["bsl1-title"]), ("CC0-1.0", ["cc0-dedication"]), ("EPL-2.0", ["epl2-grant"]), ("MPL-2.0", ["mpl2-ref", "mpl2-copy"]),
    ("GPL-2.0", ["gpl2-title"]), ("GPL-3.0", ["gpl3-title"]), ("AGPL-3.0", ["agpl3-title"]), ("LGPL-2.1", ["lgpl21-title"]), ("LGPL-3.0", ["lgpl3-title"]),
    ("Unlicense", ["unlicense-grant", "unlicense-anyone"]), ("Unlicense", ["unlicense-grant"]), ("WTFPL", ["wtfpl-title"]),
    ("Zlib", ["zlib-warranty", "zlib-grant", "zlib-altered", "zlib-notice"]), ("Zlib", ["zlib-warranty", "zlib-grant"]),
    *(("", [x]) for x in ("as-is-apache", "bsd-warranty", "bsd-liability", "gnu-received-gpl", "gnu-received-lgpl", "gnu-see", "gnu-see-lesser", "gnu-warranty", "isc-warranty", "mit-warranty", "mit-liability", "mpl2-copy", "zlib-warranty", "zlib-altered", "zlib-notice")),
]
# A sentence from the body of licences whose full text may come without its title.
BODIES = {
    "GPL-3.0": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "AGPL-3.0": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "LGPL-3.0": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "GPL-2.0": "this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it",
    "LGPL-2.1": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "Apache-2.0": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "MPL-2.0": "means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "CC-BY-4.0": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license",
    "CC-BY-SA-4.0": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license public license",
    "CC-BY-NC-4.0": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license public license",
}
for _name, _text in BODIES.items():
    SENTENCES[f"body-{_name.lower()}"] = _text
    RULES.append((_name, [f"body-{_name.lower()}"]))
# One-line references are made from a licence's names and the ways to refer to it.
REFERRED = {
    "MIT": ["mit"], "Apache-2.0": ["apache 2 0", "apache license 2 0", "apache license version 2 0"], "Apache": ["apache"], "BSD-2-Clause": ["bsd 2 clause", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "new bsd", "modified bsd"], "BSD": ["bsd"], "ISC": ["isc"], "Zlib": ["zlib"], "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license 2 0", "epl 2 0"], "GPL-2.0": ["gpl 2 0", "gplv2", "gnu gpl v2", "gnu general public license version 2"], "GPL-3.0": ["gpl 3 0", "gplv3", "gnu gpl v3", "gnu general public license version 3"],
    "LGPL-2.1": ["lgpl 2 1", "gnu lesser general public license version 2 1"], "LGPL-3.0": ["lgpl 3 0", "gnu lesser general public license version 3"], "AGPL-3.0": ["agpl 3 0", "gnu affero general public license version 3"],
    "BSL-1.0": ["boost software license 1 0", "boost software license version 1 0"], "CC0-1.0": ["cc0", "cc0 1 0"], "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"], "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
}
WAYS = ["licensed under the {} license", "released under the {}", "licensed under {}", "licensed under the {}", "released under the {} license", "distributed under the {} license", "this project is licensed under the {} license", "this work is licensed under the {}"]
for _name, _forms in REFERRED.items():
    for _form in _forms:
        for _way in WAYS:
            _text = _way.format(_form).replace("license license", "license")
            if _text not in SENTENCES.values():
                _id = _text.replace(" ", "-")
                SENTENCES[_id] = _text
                RULES.append((_name, [_id]))
# Spellings that mean the same, in normalised sentences.
ALIKE = [(r"\blicenc", "licens"), (r"\bcopyright (?:owners?|holders)\b", "copyright holder"), (r"\bhttps\b", "http"), (r"\bthis (?:repository|package|module|code)\b", "this project")]
for _pattern, _plain in ALIKE:
    SENTENCES = {_i: re.sub(_pattern, _plain, _s) for _i, _s in SENTENCES.items()}


TAKEN = "<>"  # what stays of a match in a sequence of identifiers


def ordered(rules: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """Longer sequences first, else as given."""
    return sorted(rules, key=lambda r: -len(r[1]))


def triggers_of(known: dict[str, str]) -> list[str]:
    """A few words of which every known sentence holds one; of a word that has two spellings, what is common to them."""
    words = {i: {"licen" if w.startswith("licens") else w for w in s.split() if len(w) > 5 and w not in ("holder", "project")} or set(s.split()) for i, s in known.items()}
    out: list[str] = []
    while words:
        count: dict[str, int] = {}
        for own in words.values():
            for w in own:
                count[w] = count.get(w, 0) + 1
        best = min(count, key=lambda w: (-count[w], w))
        out.append(best)
        words = {i: own for i, own in words.items() if best not in own}
    return out


def sentences(text: Column) -> Column:
    joined = F.regexp_replace(text, r"\n([a-z])", " $1")
    return F.split(F.regexp_replace(joined, r"([.!?])[ \t]+", "$1\n"), "\n")


def normalised(sentence: Column) -> Column:
    out = F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")
    for pattern, plain in ALIKE:
        out = F.regexp_replace(out, pattern, plain)
    return F.trim(out)


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """doc_id; found: (place of the sentence, identifier) in order; licences."""
    table = F.create_map(*(F.lit(x) for i, s in known.items() for x in (s, i)))
    triggers = triggers_of(known)
    placed = F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.cast("long").alias("place"), F.when(_any(F.lower(s), triggers), F.try_element_at(table, normalised(s))).alias("id")))
    none = F.array().cast("array<struct<place:bigint,id:string>>")
    found = docs.select("doc_id", F.when(_any(F.lower("text"), triggers), F.filter(placed, lambda x: x["id"].isNotNull())).otherwise(none).alias("found"))
    sequence = F.array_join(F.transform("found", lambda x: F.concat(F.lit("<"), x["id"], F.lit(">"))), "")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(_sequence(r)).alias("need")) for name, r in ordered(rules)))
    begin = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("met"))

    def take(state: Column, rule: Column) -> Column:
        here = F.contains(state["left"], rule["need"])
        met = F.when(here & (rule["name"] != ""), F.array_append(state["met"], rule["name"])).otherwise(state["met"])
        return F.struct(F.when(here, F.replace(state["left"], rule["need"], F.lit(TAKEN))).otherwise(state["left"]).alias("left"), met.alias("met"))

    met = F.array_sort(F.array_distinct(F.aggregate(table, begin, take, lambda s: s["met"])))
    return found.select("doc_id", "found", F.when(F.size("found") > 0, met).otherwise(F.array().cast("array<string>")).alias("licences"))


def _sequence(identifiers: list[str]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def report(docs: DataFrame) -> DataFrame:
    """One row a document: how many licence sentences, their places and identifiers, the licences, as text."""
    x = scan(docs)
    return x.select(
        "doc_id", F.size("found").cast("long").alias("n_sentences"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["place"].cast("string"), s["id"])), " ").alias("sentences"),
        F.array_join("licences", " ").alias("licences"),
    )


def oracle() -> str:
    """The same report as DuckDB SQL."""
    values = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"({k}, '{n}', '{_sequence(r)}')" for k, (n, r) in enumerate(ordered(RULES), 1))
    norm = "regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')"
    for pattern, plain in ALIKE:
        norm = f"regexp_replace({norm}, '{pattern}', '{plain}', 'g')"
    return rf"""
with recursive known(id, norm) as (values {values}),
rules(k, licence, need) as (values {rules}),
cut as (
  select rowid_ as r, doc_id, unnest(ss) as s, unnest(range(len(ss))) as place from (
    select row_number() over () as rowid_, doc_id,
      string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n([a-z])', ' \1', 'g'), '([.!?])[ \t]+', E'\\1\n', 'g'), E'\n') as ss
    from documents)),
found as (
  select r, doc_id, place, id from cut join known on norm = trim({norm})),
lists as (
  select r, doc_id, count(*) as n, string_agg(place || ':' || id, ' ' order by place) as sentences,
    string_agg('<' || id || '>', '' order by place) as seq
  from found group by r, doc_id),
walk as (
  select r, 0 as k, seq as left_, []::varchar[] as met from lists
  union all
  select w.r, w.k + 1, replace(left_, need, '{TAKEN}'), case when contains(left_, need) and licence <> '' then list_append(met, licence) else met end
  from walk w join rules on rules.k = w.k + 1),
met as (select r, array_to_string(list_sort(list_distinct(met)), ' ') as licences from walk where k = (select max(k) from rules))
select d.doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(sentences, '') as sentences, coalesce(licences, '') as licences
from (select row_number() over () as r, doc_id from documents) d left join (select r, n, sentences from lists) using (r) left join met using (r)
"""
