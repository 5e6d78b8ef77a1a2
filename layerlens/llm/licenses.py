"""Licences by sentence rules.

A text is cut into sentences, normalised (A-Z in lower case, everything but letters and digits
as one space). Sentences known from licences become identifiers; a licence is found where the
identifiers of a text hold the licence's rule as a run. The colon of an
SPDX tag does not end a sentence: a tag and its value are one. Unknown sentences between known ones do
not matter. Texts are read three times over, with line ends as sentence ends, as spaces, and as
sentence ends only at blank lines and before lines that begin like a known sentence, so that
one-line notices, wrapped paragraphs and paragraphs below a title are all seen. Sentences are
stored as `ENDS` cuts the licences. No shuffle: one projection of the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from layerlens.llm.common import fresh

# Public licence sentences, normalised, under identifiers of our own.
SENTENCES = {
    "mit-name": ["released under the mit license", "licensed under the mit license", "the mit license mit", "mit license"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the "
        "following conditions",
    ],
    "mit-keep": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
    ],
    "apache2-name": [
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
    ],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl3-name": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ],
    "gpl-redistribute": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    ],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    ],
    "ccbync4-name": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "ccby4-name": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "ccbysa4-name": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "bsd-warranty": [
        f"this software is provided by the copyright {x} and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
        "are disclaimed" for x in ("holders", "holder", "owner")
    ],
    "bsd3-endorse": [
        f"neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission"
        for x in ("the copyright holder", "the copyright owner", "the author", "the project", "the organization")
    ],
    "zlib-grant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions",
    ],
    "cc0-title": ["cc0 1 0 universal", "creative commons cc0 1 0 universal"],
    "epl2-made": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        f"{x} which is available at {y} www eclipse org legal epl {z}"
        for x in ("2 0", "v 2 0", "v2 0") for y in ("http", "https") for z in ("2 0", "v20 html")
    ],
}

_ANY_LATER = "either version {} of the license or at your option any later version"
_MAY = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
for _kind, _name in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl")):
    SENTENCES[f"{_name}-may"] = [_MAY.format(_kind)]
    SENTENCES[f"{_name}3-may"] = [f"{_MAY.format(_kind)} {_ANY_LATER.format(3)}"]
    SENTENCES[f"{_name}-title"] = [f"gnu {_kind}general public license"]
SENTENCES |= {
    "any-later2": [_ANY_LATER.format(2)], "any-later3": [_ANY_LATER.format(3)],
    "gpl2-date": ["version 2 june 1991"], "gpl3-date": ["version 3 29 june 2007"], "agpl3-date": ["version 3 19 november 2007"],
    "gpl2-may": [f"{_MAY.format('')} {_ANY_LATER.format(2)}"],
    "apache-title": ["apache license"], "apache2-date": ["version 2 0 january 2004"],
    "isc-grant": [
        f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
        for x in ("and", "and or")
    ],
    "mpl2-subject": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2-copy": [
        f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0"
        for x in ("http", "https")
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: What a notice of one sentence calls a licence, by the identifier it gives.
NAMES = {
    "mit-name": ["the mit license"],
    "apache2-name": ["the apache license version 2 0", "the apache license 2 0", "the apache 2 0 license"],
    "gpl3-name": ["the gnu general public license version 3", "the gnu general public license v3 0", "the gpl 3 0 license"],
    "ccby4-name": ["cc by 4 0", "a creative commons attribution 4 0 international license"],
    "ccbync4-name": ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"],
    "ccbysa4-name": ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"],
    "isc-name": ["the isc license"],
    "mpl2-name": ["the mozilla public license version 2 0", "the mozilla public license 2 0"],
    "bsd2-name": ["the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license"],
    "bsd3-name": ["the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license"],
    "zlib-name": ["the zlib license"],
    "cc0-name": ["cc0 1 0", "cc0 1 0 universal", "the creative commons cc0 1 0 universal license"],
    "epl2-name": ["the eclipse public license 2 0", "the eclipse public license version 2 0", "the eclipse public license v2 0"],
    "gpl2-name": ["the gnu general public license version 2", "the gnu general public license v2 0", "the gpl 2 0 license"],
    "lgpl3-name": ["the gnu lesser general public license version 3"],
    "agpl3-name": ["the gnu affero general public license version 3"],
}
for _name, _called in NAMES.items():
    SENTENCES[_name] = list(dict.fromkeys([*SENTENCES.get(_name, []), *(
        f"{subject}{verb} under {terms}{called}"
        for subject in ("", "this project is ", "this software is ", "this work is ", "this program is ", "this code is ", "this file is ")
        for verb in ("licensed", "released", "distributed")
        for terms in ("", "the terms of ")
        for called in _called
    )]))

#: Licences by the values an SPDX tag has for them.
SPDX = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"],
    "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "CC0-1.0": ["CC0-1.0"],
    "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "EPL-2.0": ["EPL-2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"],
    "Unlicense": ["Unlicense"], "Zlib": ["Zlib"],
}
TAG = "spdx license identifier"
SENTENCES |= {
    f"spdx-{license}": [f"{TAG} " + re.sub("[^a-z0-9]+", " ", value.lower()) for value in values]
    for license, values in SPDX.items()
}

#: The licences and the runs of identifiers that name them. `BSD` is a grant whose clauses do not tell which.
RULES = [
    *[(license, [f"spdx-{license}"]) for license in SPDX],
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]), ("BSD-2-Clause", ["bsd2-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd3-endorse"]), ("BSD-3-Clause", ["bsd3-name"]),
    ("Zlib", ["zlib-grant"]), ("Zlib", ["zlib-name"]), ("CC0-1.0", ["cc0-title"]), ("CC0-1.0", ["cc0-name"]),
    ("EPL-2.0", ["epl2-made"]), ("EPL-2.0", ["epl2-name"]), ("GPL-2.0", ["gpl2-name"]),
    ("LGPL-3.0", ["lgpl3-name"]), ("AGPL-3.0", ["agpl3-name"]),
    ("AGPL-3.0", ["agpl3-may"]), ("AGPL-3.0", ["agpl-may", "any-later3"]), ("AGPL-3.0", ["agpl-title", "agpl3-date"]),
    ("Apache-2.0", ["apache-title", "apache2-date"]),
    ("GPL-2.0", ["gpl2-may"]), ("GPL-2.0", ["gpl-may", "any-later2"]), ("GPL-2.0", ["gpl-title", "gpl2-date"]),
    ("GPL-3.0", ["gpl3-may"]), ("GPL-3.0", ["gpl-may", "any-later3"]), ("GPL-3.0", ["gpl-title", "gpl3-date"]),
    ("ISC", ["isc-grant"]), ("ISC", ["isc-name"]),
    ("LGPL-3.0", ["lgpl3-may"]), ("LGPL-3.0", ["lgpl-may", "any-later3"]), ("LGPL-3.0", ["lgpl-title", "gpl3-date"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]), ("MPL-2.0", ["mpl2-name"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache2-name"]), ("Apache-2.0", ["apache2-use", "apache2-copy"]),
    ("BSD", ["bsd-grant", "bsd-source"]),
    ("CC-BY-4.0", ["ccby4-name"]), ("CC-BY-NC-4.0", ["ccbync4-name"]), ("CC-BY-SA-4.0", ["ccbysa4-name"]),
    ("GPL-3.0", ["gpl3-name"]), ("GPL-3.0", ["gpl-redistribute", "gpl-hope"]),
    ("MIT", ["mit-name"]), ("MIT", ["mit-grant", "mit-keep"]),
]

#: A licence that is not told where one of these is found.
GENERAL = {"BSD": ["BSD-2-Clause", "BSD-3-Clause"]}

ENDS = r"[.!?;:]+[ \t\r\n]+"
#: The tag before its value; its colon is taken out before a text is cut.
TAGGED = r"(spdx[-_ ]license[-_ ]identifier)[ \t]*:[ \t]*"
#: A line end before a line without letters and digits, and one before a known beginning.
BLANK = r"\n(?:[^a-z0-9\n]*\n)+"
BEGINS = r"\n(?=[^a-z0-9\n]*(?:{})(?:[^a-z0-9]|$))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """The form in which sentences are compared."""
    sentence = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return re.sub("[^a-z0-9]+", " ", sentence).strip(" ")


def identifiers(text: Column, ends: str, sentences: dict[str, list[str]]) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = {s: name for name, forms in sentences.items() for s in forms}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    cut = F.split(F.regexp_replace(lowered, TAGGED, "$1 "), ends)
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.transform(F.filter(plain, lambda s: s.isin(list(known))), lambda s: F.element_at(table, s))


def blocks(sentences: dict[str, list[str]]) -> str:
    """Sentence ends of wrapped paragraphs below titles and copyright lines."""
    return "|".join([ENDS, BLANK, BEGINS.format("|".join(beginnings(sentences)))])


def beginnings(sentences: dict[str, list[str]]) -> list[str]:
    """Patterns of the first words of the known sentences."""
    return sorted({"[^a-z0-9]+".join(s.split(" ")[:3]) for forms in sentences.values() for s in forms})


def scan(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES, general=GENERAL) -> tuple[DataFrame, str]:
    """All columns and a struct (licenses, sentences) under the returned name.

    `licenses` are the licences found, each once, sorted; `sentences` the identifiers as read by
    line. Null and empty texts have none; repeated rows are read alike.
    """
    (name,) = fresh(docs, "license_scan")
    rows = docs.withColumn(name, F.struct(
        identifiers(F.col(text), ENDS + "|\n", sentences).alias("lines"),
        identifiers(F.col(text), ENDS, sentences).alias("wrapped"),
        identifiers(F.col(text), blocks(sentences), sentences).alias("blocks"),
    ))
    # A line end stands between the readings: no run goes over two of them.
    read = F.concat_ws("\n", *[
        F.concat(F.lit(","), F.array_join(F.col(f"`{name}`.{c}"), ","), F.lit(",")) for c in ("lines", "wrapped", "blocks")
    ])
    found = F.array(*[F.when(read.contains("," + ",".join(run) + ","), F.lit(license)) for license, run in rules])
    found = F.sort_array(F.array_distinct(F.array_compact(found)))
    for license, special in general.items():
        told = F.arrays_overlap(found, F.array(*[F.lit(x) for x in special]))
        found = F.when(told, F.array_remove(found, license)).otherwise(found)
    verdict = F.struct(found.alias("licenses"), F.col(f"`{name}`.lines").alias("sentences"))
    return rows.withColumn(name, verdict), name
