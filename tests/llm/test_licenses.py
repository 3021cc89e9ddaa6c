"""Licence texts, notices and tags as they come, wrapped and in comments, against a plain version."""

import re

import duckdb

from packlens.llm import licenses
from tests.llm import brute

MIT = """MIT License

Copyright (c) 2020 A. Nyone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation{} either version {} of the License, or
 * (at your option) any later version.
 */"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GOOGLE = ENDORSE.replace("the copyright holder", "Google Inc.")
ADVERT = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of X. Y. and its contributors.
"""
APACHE_TITLE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"
CASES = [
    (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + ENDORSE, "BSD-3-Clause"), (APACHE, "Apache-2.0"), (GPL.format("", ",", 3), "GPL-3.0-or-later"), (GPL.format("", ";", 2), "GPL-2.0-or-later"),
    (GPL.format("Lesser ", ";", "2.1"), "LGPL-2.1-or-later"), (GPL.format("Lesser ", ",", 3), "LGPL-3.0-or-later"), (GPL.format("Affero ", ",", 3), "AGPL-3.0-or-later"), (ISC, "ISC"), (MPL, "MPL-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", "GPL-3.0-only"), ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0-or-later"),
    ("Some words\nReleased under the MIT License\nmore words " * 3, "MIT"), ("All rights reserved.", "All-Rights-Reserved"), ("mit license is a word of mine", ""), (None, ""), ("", ""), ("word. " * 200_000 + "\nThis work is in the public domain", "Public-Domain"),
    # named holders, with and without a full stop in the name
    (BSD + GOOGLE, "BSD-3-Clause"), ((BSD + GOOGLE).upper(), "BSD-3-Clause"), (BSD + ENDORSE.replace("the copyright holder", "Foo S.p.A. Bar"), "BSD-3-Clause"),
    (BSD + "\n3. The name of the author may not be used to endorse or promote products derived\nfrom this software without specific prior written permission.\n", "BSD-3-Clause"), (BSD + ADVERT + ENDORSE.replace("3.", "4."), "BSD-4-Clause"),
    (BSD + ENDORSE.replace("may be used", "may ever be used"), "BSD-2-Clause"), ("Copyright (c) 2012, Acme Inc. " + MIT, "MIT"), (MIT.replace("\n", "\n# "), "MIT"), ("<!-- " + BSD.replace("\n", " ") + " -->", "BSD-2-Clause"),
    # notices inside longer sentences
    ("This software is licensed under the MIT License.", "MIT"), ("Released under the MIT license, see LICENSE.", "MIT"), ("It may be used under either the MIT license or the Apache License, Version 2.0.", "MIT,Apache-2.0"),
    ("You may redistribute it; distributed under the terms of the GNU GPL v3 or later, as you like", "GPL-3.0-or-later"), ("The code is available under the 3-clause BSD license and the docs under CC-BY-4.0", "BSD-3-Clause"), ("Docs are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Not licensed under the MIT License.", ""), ("licensed under the MITRE license", ""), ("licensed under the GNU General Public License, version 2", "GPL-2.0-only"), ("Licensed under the Mozilla Public License Version 2.0!", "MPL-2.0"), ("licensed under lgpl-2.1+", "LGPL-2.1-or-later"),
    ("GPLv2+ is its name; covered under GPLv2+.", "GPL-2.0-or-later"), (APACHE_TITLE, "Apache-2.0"), ("licensed under ISC.", "ISC"), ("under license", ""),
    # SPDX expressions
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", "MIT,Apache-2.0"), ("/* SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception */", "Apache-2.0 WITH LLVM-exception"), ("SPDX-License-Identifier: (MIT OR GPL-3.0+) AND BSD-2-Clause", "MIT,GPL-3.0+,BSD-2-Clause"),
    ("<!-- SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR MIT -->\nmore", "GPL-2.0-only WITH Classpath-exception-2.0,MIT"), ("SPDX-License-Identifier:MIT", "MIT"), ("SPDX-License-Identifier: MIT OR Foo-1.0", "MIT"), ("SPDX-License-Identifier: Foo-1.0 OR MIT", ""),
    ("SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0", "MIT,Apache-2.0"),
]


def plain(text):
    """(identifiers, licences) of a text, read word by word from the rules' tables."""
    low, known = (text or "").translate(brute.A_Z), {tuple(s.split()): i for i, s in reversed(licenses.SENTENCES)}
    names = {tuple(x.split()): n for n, xs in licenses.NAMES.items() for x in xs}
    tags, exceptions = {x.lower(): x for x in [*licenses.NAMES, *licenses.TAGS]}, {x.lower(): x for x in licenses.EXCEPTIONS}
    low = re.sub(r"spdx-license-identifier:[ \t]*([^\n]*)", "\n\nspdx-license-identifier \\1\n\n", low)
    low = re.sub(r"(?a)\b(v|inc|corp|ltd|llc|co|gmbh|jr|sr|dr|st|[a-z])\.[\x20\x09-\x0D]+", r"\1 ", low)
    ids = []
    for part in re.split(r"\n[^a-z0-9\n]*\n|[.!?;:]+[\x20\x09-\x0D]+", low):
        part = re.sub(r"[.-]+ | [.+-]+", " ", re.sub(r"[^a-z0-9.+-]+", " ", part))
        w = re.sub(r"^[ .+-]+|[ .-]+\Z", "", part).split()
        ids += sentence(w, known, names, tags, exceptions)
    out, i = [], 0
    while i < len(ids):
        rule = next(((n, r) for n, r in licenses.RULES if tuple(ids[i : i + len(r)]) == r), None)
        if rule:
            out.append(rule[0])
            i += len(rule[1])
            continue
        kind, _, what = ids[i].partition(":")
        if kind == "note":
            out.append(what)
        elif kind == "spdx":
            a, _, b = what.partition("/")
            out.append(tags[a] + (f" WITH {exceptions[b]}" if b else ""))
        i += 1
    return ids, list(dict.fromkeys(out))


def longest(w, i, of):
    """The longest entry of a table of word sequences that begins at i, longest by characters."""
    found = [k for k in of if tuple(w[i : i + len(k)]) == k]
    return max(found, key=lambda k: len(" ".join(k)), default=None)


def sentence(w, known, names, tags, exceptions):
    ids, i = [], 0
    while i < len(w):
        if w[i] == "spdx-license-identifier" and i + 1 < len(w) and w[i + 1] in tags:
            i += 1
            while True:
                one, i = w[i], i + 1
                if w[i : i + 1] == ["with"] and i + 1 < len(w) and w[i + 1] in exceptions:
                    one, i = f"{one}/{w[i + 1]}", i + 2
                ids.append(f"spdx:{one}")
                if w[i : i + 1] in (["or"], ["and"]) and i + 1 < len(w) and w[i + 1] in tags:
                    i += 1
                else:
                    break
            continue
        k = longest(w, i, known)
        if k:
            ids.append(known[k])
            i += len(k)
            continue
        end = None
        for name, head, tail in licenses.SLOTS:
            h, t = head.split(), tail.split()
            if w[i : i + len(h)] == h:
                end = next((j + len(t) for j in range(i + len(h) + 1, len(w) + 1) if w[j : j + len(t)] == t), None)
                if end:
                    ids.append(name)
                    break
        if end:
            i = end
            continue
        denied = w[i] in ("not", "never")
        at = i + denied
        if at < len(w) and w[at] in licenses.VERBS:
            found, after = notice(w, at + 1, names)
            if found:
                ids += [] if denied else [f"note:{n}" for n in found]
                i = after
                continue
        i += 1
    return ids


def notice(w, i, names):
    if w[i : i + 1] != ["under"]:
        return [], i
    m = re.match(licenses.BETWEEN.replace("  ", " "), " ".join(["", *w[i:], ""]))
    while m:
        j = i + len(m[0].split())
        k = longest(w, j, names)
        if k:
            out, j = [names[k]], j + len(k)
            while w[j : j + 1] in (["or"], ["and"]):
                n = j + 1 + (w[j + 1 : j + 2] == ["the"])
                k = longest(w, n, names)
                if not k:
                    break
                out, j = [*out, names[k]], n + len(k)
            return out, j
        m = None
    return [], i


def test_texts_and_notices(spark):
    rows = [(i, t, "x", 1, "y") for i, (t, _) in enumerate(CASES)] + [(None, MIT, "x", 1, "y"), (0, MIT, "x", 1, "y"), (0, MIT, "x", 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, identifiers string, ids int, licenses string")
    got = sorted(((r.doc_id, r.n_known, r.identifiers, r.licenses) for r in licenses.licenses(df).collect()), key=str)
    want = dict(enumerate(x for _, x in CASES)) | {None: "MIT"}
    assert [(i, g) for i, _, _, g in got if g != want[i]] == []
    assert got == sorted(((i, len(ids), ",".join(ids), ",".join(names)) for i, t, *_ in rows for ids, names in [plain(t)]), key=str)


def test_texts_against_sql(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(licenses.OP6_SQL).df()
    got = licenses.op6(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want[got.columns].values.tolist()))


def test_every_rule_has_a_word_of_the_hints():
    notices = [f"{v} under {x}" for v in licenses.VERBS for xs in licenses.NAMES.values() for x in xs]
    for phrase in [*(x for _, x in licenses.SENTENCES), *(f"{a} {b}" for _, a, b in licenses.SLOTS), *notices, "spdx-license-identifier"]:
        assert any(h in w for w in phrase.split() for h in licenses.HINTS), phrase
