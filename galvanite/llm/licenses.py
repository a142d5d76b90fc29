"""Licence scan by sentences: known sentences become identifiers, ordered rules of identifiers name licences.

Column expressions only. Everything happens inside the row of a document, so
nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvanite.llm.shared import ascii_lower

# Licence sentences and their identifiers. Normalised words as patterns: a space also stands for a line
# break, E for the end of a sentence inside, NAME for the words of a holder, UNDER for the beginning of a short notice.
NAME = "[a-z0-9L ]+?(?:(?<=inc|ltd|llc|corp|co) E(?: [a-z0-9L ]+?)??){0,3}?"
UNDER = "(?:(?:this|the|these|our|all) (?:[a-z0-9]+ ){0,4}?(?:is|are) )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:the |a )?"
SENTENCES = {
    "apache license version 2 0 january 2004(?: https? www apache org licenses)?": "apache-title",
    "UNDERapache license version 2 0(?: the license)?": "apache-notice",
    "you may not use (?:this file|this work|this software|these files) except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at(?: E)? https? www apache org licenses license 2 0(?: txt| html)?": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "(?:the )?mit license(?: mit)?": "mit-title",
    "UNDERmit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense(?: E)? and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions)?": "mit-grant",
    "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies(?: or substantial portions of the software)?": "mit-keep",
    "the software is provided as is without warranty of any kind(?: express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement)?": "mit-warranty",
    "in no event shall NAME be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "(?:the )?isc license(?: isc)?": "isc-title",
    "permission to use copy modify(?: E)? and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify(?: E)? and(?: or)? distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and NAME disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "(?:the )?bsd 2 clause(?: simplified)? license": "bsd2-title",
    "(?:the )?bsd 3 clause(?: new or revised)? license": "bsd3-title",
    "UNDERbsd 2 clause(?: simplified)? license": "bsd2-notice",
    "UNDERbsd 3 clause(?: new or revised)? license": "bsd3-notice",
    "redistribution and use(?: of this software)? in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?": "bsd-use",
    "redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer in the documentation(?: E)? and or other materials provided with the distribution)?": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledge?ment": "bsd-advertising",
    "neither the names? of NAME nor the names of (?:its|their|any) contributors may be used(?: to endorse or promote products derived from this software without specific prior written permission)?": "bsd-names",
    "the names? of NAME may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by NAME as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall NAME be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services(?: E)? loss of use data or profits(?: E)? or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "(?:[a-z0-9]+ ){1,4}?is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?": "gpl-terms",
    "(?:[a-z0-9]+ ){1,4}?is distributed in the hope that it will be useful but without any warranty(?: E)? without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu (?:lesser |library |affero )?general public license for more details": "gpl-details",
    "you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with (?:this|the) [a-z0-9]+": "gpl-copy",
    "mozilla public license version 2 0": "mpl2-title",
    "this source code form is subject to the terms of the mozilla public license v(?: E)? 2 0": "mpl2-notice",
    "UNDERmozilla public license(?: version| v(?: E)?)? 2 0": "mpl2-short",
    "if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0": "mpl2-copy",
    "(?:creative commons )?(?:cc0 1 0 universal|legal code cc0 1 0 universal)": "cc0-title",
    "to the extent possible under law NAME (?:has|have) (?:dedicated|waived) all copyright and related (?:and|or) neighboring rights to NAME": "cc0-waiver",
    "you should have received a copy of the cc0 public domain dedication along with this (?:software|work)": "cc0-copy",
    "this is free and unencumbered software released into the public domain": "unlicense",
    r"spdx license identifier[a-z0-9\x20]*?": "spdx",
}
for _kind, _words in {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}.items():
    SENTENCES[f"UNDER(?:cc {_kind.replace('-', ' ')} 4 0|creative commons {_words} 4 0(?: international)?(?: license)?)"] = f"cc-{_kind}-4"
GNU = [("gpl", "general", "1", "1 february 1989"), ("gpl", "general", "2", "2 june 1991"), ("gpl", "general", "3", "3 29 june 2007"), ("lgpl", "library general", "2", "2 june 1991"), ("lgpl", "lesser general", "2 1", "2 1 february 1999"), ("lgpl", "lesser general", "3", "3 29 june 2007"), ("agpl", "affero general", "3", "3 19 november 2007")]
for _short, _words, _version, _title in GNU:
    _id, _name = _short + _version.replace(" ", "."), f"gnu {_words} public license"
    _begin = f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation(?: E)?"
    _either = f"either version {_version}(?: of the license)? or at your option any later version"
    _notice = f"UNDER(?:{_name}|(?:gnu )?{_short})(?: version| v)? ?{_version}(?: 0)?"
    SENTENCES |= {
        f"{_name} version {_title}": f"{_id}-title",
        f"{_begin} {_either}": f"{_id}-terms-later",
        f"{_begin}(?: under)? version {_version}(?: of the license)?(?: only)?": f"{_id}-terms-only",
        f"you can redistribute it and or modify it under the terms of version {_version} of the {_name} as published by the free software foundation": f"{_id}-terms-only",
        f"{_notice} or(?: at your option)?(?: any)? later(?: version)?": f"{_id}-notice-later",
        f"{_notice}(?: only)?": f"{_id}-notice",
    }
    SENTENCES.setdefault(_either, f"gpl{_id.removeprefix('a').removeprefix('l').removeprefix('gpl')}-later")
# Licence and the identifiers that follow each other, alternatives between bars; longer rules come first.
_SPDX = [(f"{short.upper()}-{version.replace(' ', '.')}{'' if ' ' in version else '.0'}", short + version.replace(" ", ".")) for short, _, version, _ in GNU]
RULES = [
    ("BSD-4-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-4-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    # The whole text of a licence ends with its notice for programs, which then says nothing of later versions.
    *[(name, [f"{i}-title", "gpl-free", f"{i}-terms-later|{i}-terms-only"]) for name, i in _SPDX],
    *[(f"{name}-or-later", ["gpl-free", f"{i}-terms-later"]) for name, i in _SPDX],
    *[(name, ["gpl-free", f"{i}-terms-only"]) for name, i in _SPDX],
    *[(f"{name}-or-later", ["gpl-free", "gpl-terms", f"{i}-later"]) for name, i in _SPDX if i.startswith("gpl")],
    *[(f"{name}-or-later", [f"{i}-terms-later|{i}-notice-later"]) for name, i in _SPDX],
    *[(name, [f"{i}-terms-only|{i}-notice|{i}-title"]) for name, i in _SPDX],
    ("Apache-2.0", ["apache-notice|apache-title|apache-copy"]),
    ("MIT", ["mit-notice|mit-title"]),
    ("ISC", ["isc-grant|isc-title"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-2-Clause", ["bsd2-title|bsd2-notice"]),
    ("BSD-3-Clause", ["bsd3-title|bsd3-notice"]),
    ("MPL-2.0", ["mpl2-notice|mpl2-title|mpl2-short|mpl2-copy"]),
    ("CC0-1.0", ["cc0-waiver|cc0-title|cc0-copy"]),
    ("Unlicense", ["unlicense"]),
    *[(f"CC-{k.upper()}-4.0", [f"cc-{k}-4"]) for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")],
]
END = r"[.!?;:]+(?=\s|$)|,\s+(?=and/or\b)"
# The named licences of an SPDX line, as far as it follows the grammar of expressions; a `with` belongs to its licence.
_ONE = r"[( \t]*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?(?:[ \t]+with[ \t]+[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)?[) \t]*+"
SPDX = rf"(?i)spdx-license-identifier:({_ONE}(?:(?<=[) \t])(?:and|or)(?=[( \t]){_ONE})*)"
WRITTEN = {name.lower(): name for name, _ in RULES} | {f"{name}-only".lower(): f"{name}-only" for name, _ in _SPDX}


def pattern(sentence: str) -> str:
    """Regular expression of a sentence of the table on normalised text."""
    return re.sub(r" (?!\?)", "(?: L)? ", sentence.replace("UNDER", UNDER)).replace("NAME", NAME)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Normalised text has words, L for the end of a line and E for the end of a
    sentence: punctuation, or a line without words. A known sentence begins and
    ends at such marks and may run over lines.
    """
    plain = F.regexp_replace(F.concat(F.lit("\n"), ascii_lower(F.coalesce(text, F.lit("")))), END, " E ")
    plain = F.regexp_replace(plain, r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:dnl|rem)\b)?", " L ")
    plain = F.regexp_replace(plain, "[^a-z0-9EL]+", " ")
    plain = F.concat(F.lit("E "), F.regexp_replace(plain, "L(?: L)++", "E"), F.lit(" E"))
    plain = F.regexp_replace(plain, " {2,}", " ")
    lead = "(?:[0-9]{1,2} |[a-z] )?"
    known = {pattern(s): i for s, i in sorted(SENTENCES.items(), key=lambda x: -len(x[0]))}
    any_of = rf"(?<=[EL] ){lead}(?:{'|'.join(known)})(?= [EL])"
    found = F.regexp_extract_all(plain, F.lit(any_of), F.lit(0))
    named = lambda s: F.coalesce(*[F.when(s.rlike(f"^{lead}(?:{p})$"), F.lit(i)) for p, i in known.items()])
    return F.filter(F.transform(found, named), lambda i: i.isNotNull())


def spdx_names(text: Column) -> Column:
    """Licences of the SPDX lines of a text: known ones as in the rules, others as written."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPDX), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, "[()]", " "), r"(?i)\s(?:and|or)\s")))
    names = F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    written = F.create_map(*[F.lit(x) for pair in WRITTEN.items() for x in pair])
    return F.filter(F.transform(names, lambda x: F.coalesce(written[ascii_lower(x)], x)), lambda x: x != "")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (comma-joined, sorted), n_sentences, sentence_ids per row of `docs`.

    Longer rules are matched first and use up their identifiers. Null texts
    have no sentences; null ids stay; repeated rows repeat.
    """
    df = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"), spdx_names(F.col("text")).alias("spdx"))
    # Each identifier stands between its own marks, so that a rule is a plain pattern.
    df = df.withColumn("rest", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    found = []
    for n, (name, ids) in enumerate(RULES):
        rule = "".join(f"<(?:{i.replace('.', chr(92) + '.')})>" for i in ids)
        df = df.withColumns({f"r{n}": F.when(F.col("rest").rlike(rule), F.lit(name)), "rest": F.regexp_replace("rest", rule, "|")})
        found.append(f"r{n}")
    names = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*found)), F.col("spdx"))))
    return df.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
