"""Licence recognition by sentence: sentences to identifiers, identifier sequences to ordered licence rules."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, in normalised form (see ``sentences_of``).
NOTICES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license 2.0",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl2+-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3+-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl2.1+-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl3+-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3+-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
}
# Sentences in which each holder writes a name of their own, at <>; the names may hold up to 120 characters.
SLOTS = {
    "bsd-endorse": (
        "neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of <> nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of <> may not be used to endorse or promote products derived from this software without specific prior written permission",
        "the names of <> may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-asis": (
        "this software is provided by <> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "mit-liability": (
        "in no event shall <> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "isc-asis": (
        "the software is provided as is and <> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
}
# Names under which a licence is granted in one sentence.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "MIT": ("mit license",),
    "ISC": ("isc license",),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gplv2 license"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gplv3 license"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0"),
    "CC0-1.0": ("cc0 1.0 license",),
    "CC-BY-4.0": ("cc by 4.0 license", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0 license", "creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0 license", "creative commons attribution noncommercial 4.0 international license"),
}
SUBJECTS = ("", "this work is ", "this project is ", "this software is ", "this file is ", "this document is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ", "licensed under the terms of ")

#: Ordered rules: the first whose identifiers stand in a row claims them.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("Apache-2.0", ("apache-header", "apache-obtain", "apache-url", "apache-asis", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-obtain", "apache-url", "apache-asis")),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0-or-later", ("gpl3+-free", "gpl-warranty", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3+-free",)),
    ("GPL-2.0-or-later", ("gpl2+-free", "gpl-warranty", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2+-free",)),
    ("LGPL-2.1-or-later", ("lgpl2.1+-free",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-asis", "zlib-liability", "zlib-grant")),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("LGPL-3.0-or-later", ("lgpl3+-free",)),
    ("AGPL-3.0-or-later", ("agpl3+-free",)),
    ("EPL-2.0", ("epl2-terms",)),
    *((name, (f"grant:{name}",)) for name in NAMES),
)


def _sentences() -> dict[str, str]:
    """Normalised sentence to identifier, the one-sentence grants spelled out from their parts."""
    known = {s: i for i, s in NOTICES.items()}
    for name, forms in NAMES.items():
        short = {f.removesuffix(" license") for f in forms if f.startswith("cc") or f.endswith("2.0 license")}
        named = [p + f for f in (*forms, *sorted(short)) for p in ("the ", "")]
        known |= {s + v + n: f"grant:{name}" for s, v, n in product(SUBJECTS, VERBS, named)}
        known[f"spdx license identifier {name.lower().replace('-', ' ')}"] = f"grant:{name}"
    return known


#: Every known sentence holds one of these, so a text without them needs no splitting.
ANCHORS = "licen[cs]e|released under|distributed under|available under|permission|redistribut|warrant|as is|liable|endorse|public domain|distributed with"
KNOWN = _sentences()
assert all(re.search(ANCHORS, s) for s in KNOWN)


def wrapped(gap: str) -> dict[str, str]:
    """Pattern of a known sentence, or of all forms of a grant, with ``gap`` between words, to the sentence on one line.
    Names of holders stand for any few words."""
    slot = f"[a-z0-9+.]+(?:{gap}[a-z0-9+.]+){{0,11}}?"
    gaps = lambda s: slot.join(re.escape(p).replace("\\ ", gap) for p in s.split("<>"))
    any_of = lambda forms: f"(?:{'|'.join(map(gaps, sorted(forms, key=len, reverse=True)))})"
    forms = {i: any_of([s, *SLOTS.get(i, ())]) for i, s in NOTICES.items()}
    for name, named in NAMES.items():
        tails = {t for s, i in KNOWN.items() if i == f"grant:{name}" for v in VERBS if s.startswith(v) for t in (s[len(v) :],)}
        spdx = gaps(f"spdx license identifier {name.lower().replace('-', ' ')}")
        forms[name] = f"(?:{any_of(SUBJECTS)}{any_of(VERBS)}{any_of(tails)}|{spdx})"
    lines = NOTICES | {name: f"licensed under {named[0]}" for name, named in NAMES.items()}
    assert all(KNOWN[line] in (i, f"grant:{i}") for i, line in lines.items())
    return {p: lines[i] for i, p in forms.items()}


WRAPPED = {f"(?<![^\n|]){p}(?![^\n|])": line for p, line in wrapped("[ \n]").items()}


def sentences_of(text: Column) -> Column:
    """Normalised sentences: lower case; only letters a-z, digits, ``+`` and points inside stay, parted by one space.

    A line that goes on in lower case (behind comment marks) is joined, then the text is cut at ends of sentences and
    lines. A line that goes on otherwise may be a new one or a wrapped one, so lines of one paragraph are joined where
    they make up a known sentence, and only there."""
    joined = F.translate(F.regexp_replace(text, r"\r?\n[ \t/*#;%-]*([a-z(])", " $1"), "|", "-")
    cut = F.lower(F.regexp_replace(joined, r"[.!?]+(\s|$)", "|"))  # from here on | ends a sentence or paragraph
    flat = F.regexp_replace(cut, r"[^a-z0-9+.|\n]+", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r"\n ?(\n ?)+", "|"), r" ?([\n|]) ?", "$1")

    def mended(s: Column) -> Column:
        out = s
        for pattern, line in WRAPPED.items():
            out = F.regexp_replace(out, pattern, line)
        return F.when(s.rlike("|".join(WRAPPED)), out).otherwise(s)

    return F.split(F.transform(F.array(F.trim(flat)), mended)[0], r"[\n|]")


def _identifiers(text: Column) -> Column:
    """Identifiers of the licence-like sentences of a text in order; ``?`` for an unknown one, which parts what stands
    around it, so that a changed or foreign clause never turns a longer licence into a shorter one."""
    known = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    alike = F.filter(sentences_of(text), lambda s: s.rlike(ANCHORS))
    found = F.transform(alike, lambda s: F.coalesce(known[s], F.lit("?")))
    return F.when(F.lower(text).rlike(ANCHORS), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, sentence_ids, licenses, n_unclaimed)`` per row of ``docs``, in one pass without a shuffle.

    ``sentence_ids`` are the identifiers of known licence sentences in page order, ``?`` standing for a sentence that
    holds a licence-like word (``ANCHORS``) but is not known. ``licenses`` are the licences of the rules that claimed sentences, each once,
    sorted. ``n_unclaimed`` counts identifiers that no rule claimed, unknown ones included. Null and empty texts have
    none; repeated rows and rows without an id are scanned like all others; other columns are left out."""
    ids = docs.select(F.col(id_col), _identifiers(F.coalesce(F.col(text), F.lit(""))).alias("sentence_ids"))
    row = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    for name, needed in RULES:
        row = F.replace(row, F.lit("".join(f"<{i}>" for i in needed)), F.lit(f"{{{name}}}"))
    claimed = ids.withColumn("_row", row)
    names = F.regexp_extract_all("_row", F.lit(r"\{([^}]*)\}"), F.lit(1))
    return claimed.select(
        id_col,
        "sentence_ids",
        F.array_sort(F.array_distinct(names)).alias("licenses"),
        F.size(F.regexp_extract_all("_row", F.lit("<([^>]*)>"), F.lit(1))).cast("long").alias("n_unclaimed"),
    )
