"""License scans by sentence rules (operator 6).

Sentences are normalised and mapped to known licence-sentence identifiers: known sentences as a whole or
inside a longer sentence, sentences with a slot for a holder's name by their head and tail, notices that
name a licence after "licensed under" and the like, and SPDX tags. The sequence of identifiers of a document
is then read against licence rules in their order, longer sequences first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base

#: Known sentences as normalised (fixed values): identifier, sentence.
SENTENCES = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache2-title", "apache license version 2.0 january 2004 http www.apache.org licenses"),
    ("apache2-title", "apache license version 2.0 january 2004"),
    ("apache2-terms", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("gpl3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl2-title", "gnu general public license version 2 june 1991"),
    ("lgpl3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl2-title", "gnu lesser general public license version 2.1 february 1999"),
    ("agpl3-title", "gnu affero general public license version 3 19 november 2007"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl3-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3-only", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3"),
    ("gpl2-only", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2"),
    ("lgpl-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl3-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl2-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("agpl3-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("version2-later", "either version 2 of the license or at your option any later version"),
    ("version21-later", "either version 2.1 of the license or at your option any later version"),
    ("version3-later", "either version 3 of the license or at your option any later version"),
    ("version2", "version 2 of the license"),
    ("later", "or at your option any later version"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc-terms", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl2-note", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl2-title", "mozilla public license version 2.0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl1-title", "boost software license version 1.0 august 17th 2003"),
    ("unlicense-note", "this is free and unencumbered software released into the public domain"),
    ("cc0-title", "cc0 1.0 universal"),
    ("public-domain", "this work is in the public domain"),
    ("reserved", "all rights reserved"),
]
#: Sentences with a slot of any words: identifier, head, tail.
SLOTS = [
    ("bsd-endorse", "neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "neither the names of", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "the name of", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-endorse", "the names of", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
]
#: Verbs of a notice, and what may stand between them and a licence's name.
VERBS = ["licensed", "released", "distributed", "available", "provided", "published", "covered", "redistributed", "modified", "used"]
BETWEEN = "  under(?:  the)?(?:  (?:terms|conditions)(?:  and  conditions)?  of)?(?:  (?:the|a|an|this|either|both))*  "


def _versions(names: list[str], spelled: list[str], tails: list[str] = ("", "license")) -> list[str]:
    """Every name with every spelling of its version, and words that may follow."""
    return [" ".join(x for x in (n, v, t) if x) for n in names for v in spelled for t in tails]


def _later(names: list[str]) -> list[str]:
    return [f"{n} {x}" for n in names for x in ("or later", "or any later version", "or at your option any later version", "or later version")]


_V2, _V21, _V3 = (["version " + v for v in vs] + ["v" + v for v in vs] + ["v " + v for v in vs] + vs for vs in (["2", "2.0"], ["2.1"], ["3", "3.0"]))
_FAMILIES = {"gpl": ["gnu general public license", "gnu gpl", "gpl"], "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgpl"], "agpl": ["gnu affero general public license", "gnu agpl", "agpl"]}
_CC = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}


def _gnu(family: str, spelled: list[str]) -> list[str]:
    short = [f"{family}v{v}" for v in (x for x in spelled if x[0].isdigit())] + [f"{family}-{x}" for x in spelled if x[0].isdigit()]
    return _versions(_FAMILIES[family], spelled, [""]) + short


#: Licences and the names that notices give them, normalised, built from their parts.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit license", "mit", "expat license", "mit expat license", "x11 mit license"],
    "Apache-2.0": _versions(["apache license", "apache software license", "apache"], _V2) + ["apache-2.0", "apache-2.0 license"],
    **{f"{f.upper()}-{v}-or-later": _later(_gnu(f, sp)) + [f"{f}-{v}-or-later", f"{f}v{v[0]}+", f"{f}-{v}+"] for f in _FAMILIES for v, sp in (("3.0", _V3), ("2.1", _V21), ("2.0", _V2)) if (f, v) not in (("gpl", "2.1"), ("agpl", "2.1"), ("agpl", "2.0"))},
    **{f"{f.upper()}-{v}-only": _gnu(f, sp) + [f"{f}-{v}-only"] for f in _FAMILIES for v, sp in (("3.0", _V3), ("2.1", _V21), ("2.0", _V2)) if (f, v) not in (("gpl", "2.1"), ("agpl", "2.1"), ("agpl", "2.0"))},
    "BSD-3-Clause": ["bsd 3-clause license", "bsd-3-clause license", "bsd-3-clause", "3-clause bsd license", "three-clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3-clause"],
    "BSD-2-Clause": ["bsd 2-clause license", "bsd-2-clause license", "bsd-2-clause", "2-clause bsd license", "two-clause bsd license", "simplified bsd license", "freebsd license", "bsd 2-clause"],
    "ISC": ["isc license", "isc"],
    "MPL-2.0": _versions(["mozilla public license", "mpl"], _V2, [""]) + ["mpl-2.0"],
    "EPL-2.0": _versions(["eclipse public license", "epl"], _V2, [""]) + ["epl-2.0"],
    "BSL-1.0": _versions(["boost software license"], ["version 1.0", "v1.0", "1.0"], [""]) + ["boost software license"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense"],
    **{f"CC-{k.upper()}-4.0": [f"cc {k} 4.0", f"cc-{k}-4.0", f"cc-{k} 4.0", f"cc {k} 4.0 license", *[f"creative commons {n} 4.0{t}" for n in (w, w.replace("-", " ")) for t in (" international license", " international public license", " license", " international", "")]] for k, w in _CC.items()},
    "CC0-1.0": ["cc0", "cc0 1.0", "cc0-1.0", "creative commons zero"],
}
#: SPDX identifiers that tags may hold beside those of NAMES, and exceptions to licences.
TAGS = ["0BSD", "BSD-4-Clause", "Artistic-2.0", "EUPL-1.2", "OFL-1.1", "PSF-2.0", "WTFPL", "X11", "CDDL-1.0", "EPL-1.0", "GPL-1.0-only", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GPL-2.0+", "GPL-3.0+", "LGPL-2.1+", "LGPL-3.0+", "AGPL-3.0+", "Python-2.0", "Ruby", "PostgreSQL"]
EXCEPTIONS = ["LLVM-exception", "Classpath-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception"]
#: Licence rules in order: licence, identifiers that follow one another. A notice or tag of a licence is a rule of its own.
RULES = [
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("note:Apache-2.0", "apache2-terms", "apache2-copy")),
    ("Apache-2.0", ("note:Apache-2.0", "apache2-terms")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("GPL-3.0-or-later", ("note:GPL-3.0-only", "later")),
    ("GPL-2.0-or-later", ("note:GPL-2.0-only", "later")),
    ("GPL-3.0-or-later", ("gpl-terms", "version3-later")),
    ("GPL-2.0-or-later", ("gpl-terms", "version2-later")),
    ("GPL-2.0-only", ("gpl-terms", "version2")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "version3-later")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "version21-later")),
    ("MIT", ("note:MIT", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-title",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl2-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-only", ("lgpl2-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-title",)),
    ("Unlicense", ("unlicense-note",)),
    ("CC0-1.0", ("cc0-title",)),
    ("MPL-2.0", ("mpl2-note",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("reserved",)),
]
#: Words one of which is in whatever is known: other texts, and other sentences, are not looked at further.
HINTS = ["licens", "permi", "redistribut", "domain", "reserved", "promote", "acknowledgement", "later", "cc0", "under", "conditions", "merchantability"]
#: What ends no sentence: the full stop of a mark, a title or a single letter. A tag's line is a sentence.
MARK, MARKED = r"\b(v|inc|corp|ltd|llc|co|gmbh|jr|sr|dr|st|[a-z])\.[\x20\x09-\x0D]+", r"\1 "
TAG, TAGGED = r"spdx-license-identifier:[\x20\x09]*([^\n]*)", r"\n\nspdx-license-identifier \1\n\n"
#: Sentences end at lines without a letter or digit and at these before white space; all but letters, digits, '.', '+' and '-' inside become one space.
ENDS = r"\n[^a-z0-9\n]*\n|[.!?;:]+[\x20\x09-\x0D]+"
DROPPED = r"[^a-z0-9.+-]+"
EDGES = r"^[ .+-]+|[ .-]+\z"
#: A full stop, '+' or '-' that stands at the end or start of a word and not for itself.
LOOSE = r"[.-]+ | [.+-]+"


def _escaped(words: str) -> str:
    return words.replace(".", r"\.").replace("+", r"\+").replace(" ", "  ")


def _any(of: list[str]) -> str:
    return "|".join(map(_escaped, sorted(of, key=lambda x: (-len(x), x))))


#: Inside a sentence each word has a space before and after it, so that phrases are found between whole words.
_LICENCE = _any([x for xs in NAMES.values() for x in xs])
_TAG = f"(?:{_any([x.lower() for x in [*NAMES, *TAGS]])})(?:  with  (?:{_any([x.lower() for x in EXCEPTIONS])}))?"
NOTICE = f" (?:(?:not|never)  )?(?:{'|'.join(VERBS)}){BETWEEN}(?:{_LICENCE})(?:  (?:or|and)(?:  the)?  (?:{_LICENCE}))* "
TAGS_LINE = f" spdx-license-identifier  {_TAG}(?:  (?:or|and)  {_TAG})* "
PHRASES = [x for _, x in SENTENCES]
SLOTTED = [f" {_escaped(a)}(?:  [^ ]+)+?  {_escaped(b)} " for _, a, b in SLOTS]
KNOWN = "|".join([TAGS_LINE, f" (?:{_any(PHRASES)}) ", *SLOTTED, NOTICE])
#: Identifiers are joined with a space on either side, so that rules are found between whole identifiers.
RULE = "|".join(f"(?: {'  '.join(r)} )".replace("+", r"\+").replace(".", r"\.") for _, r in RULES) + "|(?: (?:note|spdx):[^ ]+ )"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, DROPPED, " "), LOOSE, " "), EDGES, "")


def one_of(text: Column) -> Column:
    found = F.lit(False)
    for x in HINTS:
        found = found | text.contains(x)
    return found


def _pairs(of: list[tuple[str, str]]) -> Column:
    """A map compiled into the projection: no join, no shuffle."""
    return F.create_map(*[F.lit(x) for k, v in of for x in (k, v)])


def identifiers(found: Column) -> Column:
    """The identifiers, in order, of what KNOWN has found in a sentence (with spaces doubled)."""
    plain = _pairs(list({x: i for i, x in reversed(SENTENCES)}.items()))
    named = _pairs([(x, f"note:{n}") for n, xs in NAMES.items() for x in xs])
    licences = lambda m: F.transform(F.regexp_extract_all(m, F.lit(f" ({_LICENCE})"), F.lit(1)), lambda x: named[F.replace(x, F.lit("  "), F.lit(" "))])
    tags = lambda m: F.transform(F.split(F.regexp_replace(m, "^ spdx-license-identifier  | $", ""), "  (?:or|and)  "), lambda x: F.concat(F.lit("spdx:"), F.replace(x, F.lit("  with  "), F.lit("/"))))

    def of(m: Column) -> Column:
        words = F.trim(F.replace(m, F.lit("  "), F.lit(" ")))
        known = F.try_element_at(plain, words)
        slot = F.lit(None).cast("string")
        for i, head, _ in reversed(SLOTS):
            slot = F.when(words.startswith(head + " "), i).otherwise(slot)
        none = F.array().cast("array<string>")
        return F.when(m.startswith(" spdx-license-identifier "), tags(m)).when(known.isNotNull(), F.array(known)).when(slot.isNotNull(), F.array(slot)).when(m.rlike("^ (?:not|never)  "), none).otherwise(licences(F.regexp_replace(m, f"^ (?:{'|'.join(VERBS)}){BETWEEN}", " ")))

    return F.flatten(F.transform(found, of))


def known_sentences(text: Column) -> Column:
    """Identifiers in order, sentence by sentence."""

    def of(part: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.replace(normalised(part), F.lit(" "), F.lit("  ")), F.lit(" "))
        return F.when(one_of(part), identifiers(F.regexp_extract_all(spaced, F.lit(KNOWN), F.lit(0)))).otherwise(F.array().cast("array<string>"))

    def read(low: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(low, TAG, TAGGED.replace("\\1", "$1").replace("\\n", "\n")), MARK, MARKED.replace("\\1", "$1"))
        return F.when(one_of(low), F.flatten(F.transform(F.split(marked, ENDS), of))).otherwise(F.array().cast("array<string>"))

    return base.let(base.ascii_lower(text), read)


def licence_of(rule: Column) -> Column:
    """The licence that a found sequence of identifiers stands for."""
    named = _pairs([(f" {'  '.join(r)} ", n) for n, r in RULES])
    proper = _pairs([(x.lower(), x) for x in [*NAMES, *TAGS]])
    exceptions = _pairs([(x.lower(), x) for x in EXCEPTIONS])
    tag = F.split(F.regexp_replace(rule, "^ spdx:| $", ""), "/")
    of_tag = F.concat(proper[tag[0]], F.coalesce(F.concat(F.lit(" WITH "), exceptions[F.get(tag, 1)]), F.lit("")))
    return F.when(rule.startswith(" spdx:"), of_tag).otherwise(F.coalesce(F.try_element_at(named, rule), F.regexp_replace(rule, "^ note:| $", "")))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (identifiers), identifiers (in order) and licenses (distinct, in order), comma-joined.

    A null or empty text has none: 0 and empty strings. Sentences repeated in a document are found
    each time, licences are named once. A sentence may be wrapped over lines, stand in a comment or in a
    longer sentence; a notice with "not" before its verb counts for nothing. An SPDX tag names each licence of
    its expression, with its exception; a tag that holds an unknown identifier counts as far as it is known.
    Null ids and repeated rows are rows like others; an empty table gives no rows; other columns are
    ignored; long texts are read whole.
    """
    df = docs.select("doc_id", known_sentences(base.text_of()).alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    found = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(RULE), F.lit(0)), licence_of))
    return df.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("identifiers"), F.array_join(F.when(F.size("ids") > 0, found), ",").alias("licenses")).withColumn("licenses", F.coalesce("licenses", F.lit("")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(base.documents(spark, sf_dir))


def _sql() -> str:
    """The rules as SQL: no prefilter, and tables joined where the operator has maps."""
    rows = lambda of: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in of)
    known, named = rows(list({x: (x, i) for i, x in reversed(SENTENCES)}.values())), rows((f" {'  '.join(r)} ", n) for n, r in RULES)
    names, proper = rows((x, n) for n, xs in NAMES.items() for x in xs), rows((x.lower(), x) for x in [*NAMES, *TAGS, *EXCEPTIONS])
    slots = " ".join(f"WHEN starts_with(w, '{head} ') THEN ['{i}']" for i, head, _ in SLOTS)
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    marked = f"regexp_replace(regexp_replace({low}, '{TAG}', '{TAGGED}', 'g'), '{MARK}', '{MARKED}', 'g')".replace("'" + TAGGED + "'", "chr(10) || chr(10) || 'spdx-license-identifier \\1' || chr(10) || chr(10)")
    norm = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '{DROPPED}', ' ', 'g'), '{LOOSE}', ' ', 'g'), '{EDGES}', '', 'g')"
    return rf"""
WITH known(w, id) AS (VALUES {known}), named(k, license) AS (VALUES {named}), names(x, license) AS (VALUES {names}), proper(x, name) AS (VALUES {proper}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split_regex({marked}, '{ENDS}') AS ps FROM documents),
u AS (SELECT rid, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM d),
s AS (SELECT rid, i, regexp_extract_all(' ' || replace({norm('p')}, ' ', '  ') || ' ', '{KNOWN}', 0) AS ms FROM u),
m AS (SELECT rid, i, unnest(range(len(ms))) AS j, unnest(ms) AS m FROM s),
w AS (SELECT *, trim(replace(m, '  ', ' ')) AS w FROM m),
t AS (SELECT rid, i, j, CASE WHEN starts_with(m, ' spdx-license-identifier ') THEN list_transform(string_split_regex(regexp_replace(m, '^ spdx-license-identifier  | $', '', 'g'), '  (?:or|and)  '), lambda x: 'spdx:' || replace(x, '  with  ', '/'))
  WHEN id IS NOT NULL THEN [id] {slots} WHEN regexp_matches(m, '^ (?:not|never)  ') THEN []
  ELSE list_transform(regexp_extract_all(regexp_replace(m, '^ (?:{'|'.join(VERBS)}){BETWEEN}', ' '), ' ({_LICENCE})', 1), lambda x: 'name:' || replace(x, '  ', ' ')) END AS ids FROM w LEFT JOIN known USING (w)),
e AS (SELECT rid, i, j, unnest(range(len(ids))) AS k, unnest(ids) AS id FROM t),
n AS (SELECT rid, i, j, k, CASE WHEN starts_with(id, 'name:') THEN 'note:' || license ELSE id END AS id FROM e LEFT JOIN names ON id = 'name:' || x),
g AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY i, j, k) AS ids, ' ' || string_agg(id, '  ' ORDER BY i, j, k) || ' ' AS line FROM n GROUP BY rid),
f AS (SELECT rid, unnest(m) AS k, unnest(range(len(m))) AS j FROM (SELECT rid, regexp_extract_all(line, '{RULE}', 0) AS m FROM g)),
c AS (SELECT rid, j, CASE WHEN starts_with(f.k, ' spdx:') THEN a.name || coalesce(' WITH ' || b.name, '') ELSE coalesce(license, regexp_replace(f.k, '^ note:| $', '', 'g')) END AS license FROM f LEFT JOIN named ON named.k = f.k
  LEFT JOIN proper a ON a.x = string_split(regexp_replace(f.k, '^ spdx:| $', '', 'g'), '/')[1] LEFT JOIN proper b ON b.x = string_split(regexp_replace(f.k, '^ spdx:| $', '', 'g'), '/')[2]),
l AS (SELECT rid, string_agg(license, ',' ORDER BY j) AS licenses FROM (SELECT rid, license, min(j) AS j FROM c GROUP BY rid, license) GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_known, coalesce(ids, '') AS identifiers, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN g ON d.rid = g.rid LEFT JOIN l ON d.rid = l.rid
"""


OP6_SQL = _sql()
