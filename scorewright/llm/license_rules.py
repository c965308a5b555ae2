"""License scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at marks followed by a blank or the end and at line ends, each is normalised (lower case, letters
and digits, one blank), and a piece or a run of pieces that follow one another is a known license sentence if together they
have its words: known sentences hold marks ("free software; you can", "v. 2.0") and are usually wrapped over lines. Blank
lines end a run, also those that hold only a comment's prefix. In a known sentence `~` stands for one word and `*` for up to `GAP` words, such as
a holder's name. Known sentences become identifiers, and so does each name and operator of an identifier line (`MIT OR Apache-2.0`); the rest is dropped. A
document's identifier sequence is then matched against ordered rules: the first rule in the list whose identifiers occur in
it one after another names the license. An expression of several names is a license of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that `*` stands for at most.
GAP = 12
#: Sentences of well-known public license texts and notices, normalised, by identifier.
SENTENCES = {
    "APACHE_NOTICE": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "APACHE_LIMIT": ["you may not use this file except in compliance with the license"],
    "APACHE_COPY": ["you may obtain a copy of the license at"],
    "APACHE_BASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "MIT_NOTICE": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "MIT_GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT_KEEP": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS_IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "GPL3_NOTICE": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gnu gpl v3"],
    "GPL2_NOTICE": ["licensed under the gnu general public license version 2"],
    "GPL_FREE": ["this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL2_FREE": ["this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL_HOPE": ["this ~ is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL2_ONLY": [
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "this ~ is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation",
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    ],
    "GPL3_ONLY": [
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
        "this ~ is free software you can redistribute it and or modify it under the terms of version 3 of the gnu general public license as published by the free software foundation",
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
        "this ~ is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    ],
    "EITHER_MIT_APACHE": [
        "licensed under either of apache license version 2 0 or mit license at your option",
        "licensed under either of the apache license version 2 0 or the mit license at your option",
        "licensed under the apache license version 2 0 or the mit license at your option",
        "this project is dual licensed under the mit license and the apache license version 2 0",
    ],
    "LGPL_NOTICE": ["licensed under the gnu lesser general public license version 3"],
    "AGPL_NOTICE": ["licensed under the gnu affero general public license version 3"],
    "BSD_GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD_BINARY": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD_NAME": [
        "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of * nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the names of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of ~ author may not be used to endorse or promote products derived from this software without specific prior written permission",
        "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSD_NOTICE": ["licensed under the bsd license", "released under the bsd license"],
    "MPL_NOTICE": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "ISC_GRANT": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "CC_BY": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC_BY_NC": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC_BY_SA": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC0": ["released under cc0 1 0", "this work is dedicated to the public domain"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "LGPL2_FREE": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "LGPL3_FREE": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "AGPL_FREE": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3",
    ],
    "LGPL_HOPE": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "ZLIB_AS_IS": ["this software is provided as is without any express or implied warranty"],
    "ZLIB_GRANT": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "BOOST": ["boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0"],
    "BSD_ADS": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "ZERO_GRANT": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "POSTGRES_GRANT": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "OFL": ["this font software is licensed under the sil open font license version 1 1"],
    "WTFPL": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "EPL2": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    ],
    "CDDL": ["the contents of this file are subject to the terms of the common development and distribution license"],
    "MPL1_NOTICE": ["the contents of this file are subject to the mozilla public license version 1 1"],
    "EUPL": ["licensed under the eupl version 1 2", "licensed under the eupl"],
    "ARTISTIC": ["licensed under the artistic license 2 0", "licensed under the artistic license version 2 0"],
    "CC_BY_ND": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "CC_BY_NC_SA": ["licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC_BY_NC_ND": ["licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
}
#: License names of the one-line identifier notice.
SPDX = [
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "0bsd", "zlib", "bsl-1.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only", "lgpl-2.1-or-later",
    "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later", "mpl-2.0", "epl-2.0", "eupl-1.2", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "unlicense", "postgresql", "ofl-1.1", "artistic-2.0", "wtfpl",
]
#: Exceptions that `WITH` may name.
EXCEPTIONS = ["classpath-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0", "openssl-exception"]
#: Older names of the identifier notice. A `+` after a name is read as `or later`.
OLDER = {"gpl-2.0": "gpl-2.0-only", "gpl-3.0": "gpl-3.0-only", "lgpl-2.1": "lgpl-2.1-only", "lgpl-3.0": "lgpl-3.0-only", "agpl-3.0": "agpl-3.0-only", "x11": "mit", "bsd-2-clause-freebsd": "bsd-2-clause"}
SPDX_LINE = "spdx license identifier"


def spdx_words() -> dict[str, str]:
    """Normalised name or operator of an identifier line -> the name."""
    names = {n: n for n in [*SPDX, *EXCEPTIONS, "and", "or", "with"]} | OLDER
    return {re.sub("[^a-z0-9]+", " ", n): name for n, name in names.items()}


SENTENCES |= {f"SPDX_{name}": [f"{SPDX_LINE} {form}" for form, n in spdx_words().items() if n == name] for name in SPDX}
#: Ordered rules: license, identifiers that follow one another. The fullest come first.
RULES = [
    ("apache-2.0", ["APACHE_NOTICE", "APACHE_LIMIT", "APACHE_COPY", "APACHE_BASIS"]),
    ("mit", ["MIT_GRANT", "MIT_KEEP", "AS_IS"]),
    ("bsd-4-clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADS"]),
    ("bsd-3-clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME"]),
    ("bsd-2-clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("mit or apache-2.0", ["EITHER_MIT_APACHE"]),
    ("gpl-3.0-or-later", ["GPL_FREE", "GPL_HOPE"]),
    ("gpl-2.0-or-later", ["GPL2_FREE", "GPL_HOPE"]),
    ("gpl-2.0-only", ["GPL2_ONLY"]),
    ("gpl-3.0-only", ["GPL3_ONLY"]),
    ("lgpl-2.1-or-later", ["LGPL2_FREE", "LGPL_HOPE"]),
    ("lgpl-3.0-or-later", ["LGPL3_FREE"]),
    ("agpl-3.0", ["AGPL_FREE"]),
    ("zlib", ["ZLIB_AS_IS", "ZLIB_GRANT"]),
    ("isc", ["ISC_GRANT"]),
    ("postgresql", ["POSTGRES_GRANT"]),
    ("0bsd", ["ZERO_GRANT"]),
    ("agpl-3.0", ["AGPL_NOTICE"]),
    ("lgpl-3.0", ["LGPL_NOTICE"]),
    ("gpl-3.0", ["GPL3_NOTICE"]),
    ("gpl-2.0", ["GPL2_NOTICE"]),
    ("apache-2.0", ["APACHE_NOTICE"]),
    ("mpl-2.0", ["MPL_NOTICE"]),
    ("mpl-1.1", ["MPL1_NOTICE"]),
    ("epl-2.0", ["EPL2"]),
    ("cddl", ["CDDL"]),
    ("bsl-1.0", ["BOOST"]),
    ("eupl-1.2", ["EUPL"]),
    ("artistic-2.0", ["ARTISTIC"]),
    ("ofl-1.1", ["OFL"]),
    ("wtfpl", ["WTFPL"]),
    ("mit", ["MIT_NOTICE"]),
    ("bsd", ["BSD_NOTICE"]),
    ("cc-by-nc-sa-4.0", ["CC_BY_NC_SA"]),
    ("cc-by-nc-nd-4.0", ["CC_BY_NC_ND"]),
    ("cc-by-nd-4.0", ["CC_BY_ND"]),
    ("cc-by-nc-4.0", ["CC_BY_NC"]),
    ("cc-by-sa-4.0", ["CC_BY_SA"]),
    ("cc-by-4.0", ["CC_BY"]),
    ("cc0-1.0", ["CC0"]),
    ("unlicense", ["UNLICENSE"]),
    *((name, [f"SPDX_{name}"]) for name in SPDX),
]
#: Every known sentence holds one of these, so other texts have no identifiers (checked by a test).
HINTS = ("licen", "permi", "software", "copyright", "public", "redistribut", "warrant", "required by", "program", "endorse", "cc0")
#: Replaced in lower case one after another; what is left has a piece in each line, and an empty line where a run ends.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*@?(?:rem|dnl)(?=\s)", ""),  # comment prefixes in letters; others are no letters
    (r"(?<=\d)\+(?=[\s)]|$)", " or later"),
    (r"[.;:!?]+[ \t]*(?=\n|$)", ""),
    (r"(?<=spdx-license-identifier):", ""),
    (r"[.;:!?]+(?=\s)", "\n"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" ?\n ?", "\n"),
    (r"^ | $", ""),
)


def pieces(text: Column) -> Column:
    text = F.lower(text)
    for what, by in STEPS:
        text = F.regexp_replace(text, what, by)
    return text


def form_pattern(form: str, blank: str = " ") -> str:
    """A pattern of a known sentence with its gaps."""
    return form.replace(" ", blank).replace("~", r"[\p{L}\p{N}]+").replace("*", rf"[\p{{L}}\p{{N}}]+(?:{blank}[\p{{L}}\p{{N}}]+){{0,{GAP - 1}}}?")


def any_known() -> str:
    """A pattern of whole lines that are a known sentence together, the longest first."""
    forms = sorted((f for forms in SENTENCES.values() for f in forms if not f.startswith(SPDX_LINE)), key=lambda f: (-len(f), f))
    names = "|".join(form_pattern(w, "[ \n]") for w in sorted(spdx_words(), key=lambda w: (-len(w), w)))
    line = SPDX_LINE.replace(" ", "[ \n]")
    return f"(?m)^(?:{line}[ \n](?:{names})(?: (?:{names}))*|" + "|".join(form_pattern(f, "[ \n]") for f in forms) + ")$"


def known() -> Column:
    """normalised sentence without gaps -> identifier, as one literal map."""
    return F.create_map(*(F.lit(v) for name, forms in SENTENCES.items() for form in forms if not set("~*") & set(form) for v in (form, name)))


def identifiers(sentence: Column, table: Column) -> Column:
    """The identifiers of one known sentence: its own, or one for each name and operator of an identifier line."""
    words = spdx_words()
    names = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    spdx = F.create_map(*(F.lit(v) for w, n in words.items() for v in (w, f"SPDX_{n}")))
    listed = F.transform(F.regexp_extract_all(F.substring(sentence, len(SPDX_LINE) + 1, 10_000), F.lit(f"(?<= )(?:{names})(?= |$)"), F.lit(0)), lambda w: F.element_at(spdx, w))
    own = F.element_at(table, sentence)
    for name, forms in SENTENCES.items():
        if gapped := [form_pattern(f) for f in forms if set("~*") & set(f)]:
            own = F.coalesce(own, F.when(sentence.rlike(f"^(?:{'|'.join(gapped)})$"), F.lit(name)))
    return F.when(sentence.startswith(SPDX_LINE), listed).otherwise(F.array(own))


def found_ids(text: Column, table: Column | None = None) -> Column:
    """The identifiers of each known sentence of a text, in order."""
    table = known() if table is None else table
    hinted = F.lower(text).rlike("|".join(HINTS))
    found = F.regexp_extract_all(pieces(text), F.lit(any_known()), F.lit(0))
    return F.when(hinted, F.transform(found, lambda s: identifiers(F.translate(s, "\n", " "), table))).otherwise(F.array().cast("array<array<string>>"))


def sentence_ids(text: Column, table: Column | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    return F.flatten(found_ids(text, table))


def scan(docs: DataFrame, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """doc_id, license (first matching rule's; null if none), licenses (all matching rules', once, in rule order), sentence_ids.

    Identifiers of a rule must follow one another in the document's identifier sequence; sentences that are not known
    may stand between. Expressions of several names come before the rules of their names. Null and empty texts have no license. Repeated rows and null ids are kept; an empty table gives an
    empty result.
    """
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(found_ids(F.col("text").cast("string")), F.array().cast("array<array<string>>")).alias("_found"))
    rows = rows.withColumn("sentence_ids", F.flatten("_found"))
    line = F.concat(F.lit(">"), F.array_join("sentence_ids", ">"), F.lit(">"))
    hit = lambda name, ids: F.when(F.contains(line, F.lit(f">{'>'.join(ids)}>")), F.lit(name))
    texts, lines = ([hit(*r) for r in rules if r[1][0].startswith("SPDX_") == spdx] for spdx in (False, True))
    several = F.transform(F.filter("_found", lambda x: F.size(x) > 1), lambda x: F.regexp_replace(F.array_join(x, " "), "SPDX_", ""))
    found = F.array_distinct(F.array_compact(F.concat(F.array(*texts, F.lit(None).cast("string")), several, F.array(*lines, F.lit(None).cast("string")))))
    rows = rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, found).otherwise(none))
    return rows.select("doc_id", F.get("licenses", F.lit(0)).alias("license"), "licenses", "sentence_ids")
