import re
from collections import Counter

from tidemark.llm import license_scan as L

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(L.UPPER, L.LOWER)


def brute(text):
    t = (text or "").translate(LOWER)
    words = SPLIT.findall(t)
    places = [(i, x) for p, x in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    found, best = set(base), 0.0
    for t in L.template_sets():
        for i in range(0, len(words), t.step):
            b = set(words[i : i + t.width])
            if len(b & set(t.words)) >= t.overlap and all(f" {n} " in f" {' '.join(words[i : i + t.width])} " for n in t.naming) and not b & set(t.others):
                found.add(t.label)
                best = max(best, len(b & set(t.words)) / len(t.words))
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if base else best


TEXTS = [
    None, "", "!!", "Under the MIT license", "released UNDER the MIT-License under the mit license; under the mit license",
    "x under the mit\nlicense y", "Apache License, Version 2.0 and CC BY-NC 4.0\nCC by nc", "This work is licensed under the GNU General Public License",
    "this work is licensed under GNU public license 3", "licence gnu general public", "été under the mit license\tcc\nby nc ünder the mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this documentation", "cc by ncx apache license version 20", "a under the mit license" * 50,
    "redistribution and use in source and binary forms with modification\n" * 3 + "word " * 20000, "Released by\nus, " + "x " * 40 + "under MIT license released", "gnu general public license version 3 licensed under lesser",
]


#: Wrapped as licenses are; (label, text).
WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("cc-by-sa", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
]
#: Sentences near a template of another license; (labels, text).
OTHERS = [
    ("", "this library is released under the gpl license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl-2", "licensed under the mozilla public license version 2 0"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl-3", "this program is under the terms of the gnu lesser general public license version 3 or later"),
    ("", "licensed under the apache license version 1 1"),
    ("", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("", "permission to publish this note was granted by the editor free of charge to any reader of this paper"),
    ("", "the source and binary forms of these words differ with or without modification"),
    # The number must stand at the name, not somewhere near.
    ("gpl-2", "licensed under the gnu general public license version 2 see chapter 3"),
    ("", "licensed under the apache license version 1 1 see page 2"),
    ("", "licensed under the mozilla public license version 1 1 see note 2"),
    ("", "released in 1999 under a license of mit press"),
    ("", "we licensed the song under cc by band sa 4 0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3", "licensed under the gpl version 3"),
    ("gpl-3", "This program is licensed under the terms of the GNU General Public License, version 3"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
    ("lgpl-2-1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("epl-2", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("lgpl-3", "Licensed under the LGPL v3."),
    ("gpl-2", "licensed under the GPLv2"),
    ("", "SPDX-License-Identifier: GPL-1.0-only, see 3.0 and MIT"),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("", "this work is licensed under a creative commons attribution share alike 3 0 unported license"),
]


def test_wrapped_licenses_and_their_neighbours(spark):
    texts = [x for _, x in [*WRAPPED, *OTHERS]]
    filled = ["lorem ipsum " * 31 + x + "\n" + " dolor" * 200 for x in texts]
    df = spark.createDataFrame(list(enumerate([*texts, *filled])), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.license_scan(df).collect()}
    want = [x for x, _ in [*WRAPPED, *OTHERS]] * 2
    assert [got[i] for i in range(len(want))] == want


def test_matches_brute_force(spark, corpus, empty_df):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])] + [(i + 1000, t) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'b' as blocks", "'w' as w", "2 as n_words")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12)) for r in L.license_scan(df).collect())
    assert got == Counter((i, *(brute(t)[:-1]), round(brute(t)[-1], 12)) for i, t in rows)
    assert L.license_scan(empty_df).count() == 0


def test_plan_has_no_python(spark, corpus_df):
    plan = L.license_scan(corpus_df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
