"""License scans by sentence rules. DataFrame functions only.

Sentences are normalised and looked up among known licence sentences; the identifiers found, in their order, are matched against rules,
each of them a sequence of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import fold_ascii

# Sentences of public licences and notices, in normal form (A-Z in lower case, runs of other characters than letters and
# digits made one space), by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "released under the mit license",
    7: "licensed under the mit license",
    8: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    11: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    12: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    13: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    14: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    15: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    16: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    17: "this work is licensed under the gnu general public license version 3",
    18: "licensed under the gnu general public license version 3",
    19: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    20: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    21: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    22: "licensed under cc by nc 4 0",
    23: "licensed under cc by 4 0",
    24: "licensed under cc by sa 4 0",
    25: "this work is licensed under a creative commons attribution 4 0 international license",
    26: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    27: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    28: "this source code form is subject to the terms of the mozilla public license v 2 0",
    29: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    30: "all rights reserved",
    31: "this is free and unencumbered software released into the public domain",
    32: "spdx license identifier mit",
    33: "spdx license identifier apache 2 0",
    34: "spdx license identifier gpl 3 0 or later",
    35: "spdx license identifier bsd 3 clause",
    # The pieces that the marks inside published texts leave of some of them.
    36: "this program is free software",
    37: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    38: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    39: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    40: "either version 3 of the license or at your option any later version",
    41: "either version 2 of the license or at your option any later version",
    42: "this program is distributed in the hope that it will be useful but without any warranty",
    43: "without even the implied warranty of merchantability or fitness for a particular purpose",
    44: "this source code form is subject to the terms of the mozilla public license v",
    45: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    46: "spdx license identifier",
    47: "this library is free software",
    48: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    49: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    50: "either version 2 1 of the license or at your option any later version",
    51: "this library is distributed in the hope that it will be useful but without any warranty",
    52: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    53: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    54: "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    55: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    56: "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    57: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    58: "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved",
    # Below 0: pieces that say nothing by themselves ("mit" is a word of German), so that they count in rules only.
    -1: "mit",
    -2: "apache 2 0",
    -3: "gpl 3 0 or later",
    -4: "bsd 3 clause",
    -5: "bsd 2 clause",
    -6: "gpl 2 0 only",
    -7: "gpl 2 0 or later",
    -8: "gpl 3 0 only",
    -9: "lgpl 2 1 or later",
    -10: "lgpl 3 0 or later",
    -11: "agpl 3 0 or later",
    -12: "mpl 2 0",
    -13: "isc",
    -14: "epl 2 0",
    -15: "cc0 1 0",
    -16: "unlicense",
    -17: "cc by 4 0",
    -18: "cc by sa 4 0",
}
#: (licence, kind, sequence of sentences). Longer rules come before those that are part of them.
RULES = (
    ("Apache-2.0", "permissive", (2, 3, 4)),
    ("Apache-2.0", "permissive", (1,)),
    ("Apache-2.0", "permissive", (33,)),
    ("Apache-2.0", "permissive", (46, -2)),
    ("BSD-3-Clause", "permissive", (12, 13, 14, 15)),
    ("BSD-3-Clause", "permissive", (35,)),
    ("BSD-3-Clause", "permissive", (46, -4)),
    ("BSD-2-Clause", "permissive", (12, 13, 14, 16)),
    ("CC-BY-4.0", "permissive", (23,)),
    ("CC-BY-4.0", "permissive", (25,)),
    ("CC-BY-NC-4.0", "non-commercial", (22,)),
    ("CC-BY-NC-4.0", "non-commercial", (26,)),
    ("CC-BY-SA-4.0", "copyleft", (24,)),
    ("CC-BY-SA-4.0", "copyleft", (27,)),
    *(("LGPL-2.1-or-later", "copyleft", (47, 48, 50, *hope)) for hope in ((51, 43), ())),
    ("LGPL-3.0-or-later", "copyleft", (47, 49)),
    ("LGPL-3.0-or-later", "copyleft", (47, 48, 40)),
    ("LGPL-3.0-or-later", "copyleft", (36, 49)),
    ("AGPL-3.0-or-later", "copyleft", (36, 52)),
    ("EPL-2.0", "copyleft", (53,)),
    ("EPL-2.0", "copyleft", (54,)),
    ("CC0-1.0", "permissive", (55,)),
    ("CC-BY-NC-SA-4.0", "non-commercial", (56,)),
    ("FSFAP", "permissive", (58,)),
    ("BSD-2-Clause", "permissive", (46, -5)),
    ("GPL-2.0-only", "copyleft", (46, -6)),
    ("GPL-2.0-or-later", "copyleft", (46, -7)),
    ("GPL-3.0-only", "copyleft", (46, -8)),
    ("LGPL-2.1-or-later", "copyleft", (46, -9)),
    ("LGPL-3.0-or-later", "copyleft", (46, -10)),
    ("AGPL-3.0-or-later", "copyleft", (46, -11)),
    ("MPL-2.0", "copyleft", (46, -12)),
    ("ISC", "permissive", (46, -13)),
    ("EPL-2.0", "copyleft", (46, -14)),
    ("CC0-1.0", "permissive", (46, -15)),
    ("Unlicense", "permissive", (46, -16)),
    ("CC-BY-4.0", "permissive", (46, -17)),
    ("CC-BY-SA-4.0", "copyleft", (46, -18)),
    *(("GPL-2.0-or-later", "copyleft", (*terms, *hope)) for terms in ((20,), (36, 38), (36, 39, 41)) for hope in ((21,), (42, 43))),
    ("GPL-3.0-only", "copyleft", (17,)),
    ("GPL-3.0-only", "copyleft", (18,)),
    *(("GPL-3.0-or-later", "copyleft", (*terms, *hope)) for terms in ((19,), (36, 37), (36, 39, 40)) for hope in ((21,), (42, 43))),
    ("GPL-3.0-or-later", "copyleft", (34,)),
    ("GPL-3.0-or-later", "copyleft", (46, -3)),
    ("ISC", "permissive", (11,)),
    ("MIT", "permissive", (6,)),
    ("MIT", "permissive", (7,)),
    ("MIT", "permissive", (8, 9, 10)),
    ("MIT", "permissive", (32,)),
    ("MIT", "permissive", (46, -1)),
    *(("MPL-2.0", "copyleft", (form, copy)) for form in (28, 44) for copy in (29, 45)),
    ("Unlicense", "permissive", (31,)),
)
#: Every known sentence holds one of these words, so a text without them has none of the sentences. Each is in one word: there may be any
#: white space between two.
WORDS = ("licen", "permi", "copyright", "warrant", "redistribut", "compliance", "reserved", "software", "unencumbered", "mpl", "mit", "apache", "gpl", "bsd", "isc", "cc0", "epl", "cc", "domain")
#: A sentence in normal form that is only the number of a list or of a version.
NUMBER = "^[0-9]{1,3}( [0-9]{1,3}){0,3}$"

BREAK = r"[.;:!?]+(?:[\x20\x09-\x0D]+|\z)|[\x0A\x0D]+"
PARAGRAPH = r"[.;:!?]+(?:[\x20\x09-\x0D]+|\z)|\x0A[\x20\x09\x0D#*/;-]*\x0A"


def _identifiers(folded: Column, pattern: str) -> Column:
    """The identifiers of a text's sentences in order, 0 for one that is not known; empty sentences and numbers of lists do not count."""
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    normal = F.transform(F.split(folded, pattern, -1), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " ")))
    return F.transform(F.filter(normal, lambda s: (s != "") & ~s.rlike(NUMBER)), lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)))


def _found(sequence: Column, column: int) -> Column:
    names = [F.when(F.contains(sequence, F.lit("," + ",".join(map(str, rule[2])) + ",")), F.lit(rule[column])) for rule in RULES]
    return F.array_compact(F.array(*names))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones with an identifier above 0), sentence_ids (theirs), licenses, kinds.

    Sentences end at . ; : ! ? before white space or the end, and at line ends; a second reading runs on over single line ends, for texts
    that are wrapped. A rule matches where its identifiers follow each other with no other sentence between, but for numbers of lists. sentence_ids (first reading),
    licenses and kinds are joined by commas, the last two sorted and without repeats; they are empty where nothing is found.

    Null and empty texts have none. Ids may be null and repeat; texts of any length are read whole, each row by itself: nothing is
    shuffled. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("folded"))
    some = F.lit(False)
    for w in WORDS:
        some = some | F.contains("folded", F.lit(w))
    none = F.array().cast("array<int>")
    joined = lambda ids: F.concat(F.lit(","), F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit(","))
    rows = rows.select("doc_id", F.when(some, _identifiers(F.col("folded"), BREAK)).otherwise(none).alias("lines"), F.when(some, _identifiers(F.col("folded"), PARAGRAPH)).otherwise(none).alias("wrapped"))
    rows = rows.select("doc_id", F.filter("lines", lambda i: i > 0).alias("ids"), F.concat(joined(F.col("lines")), joined(F.col("wrapped"))).alias("sequence"))
    sorted_names = lambda c: F.array_join(F.array_sort(F.array_distinct(_found(F.col("sequence"), c))), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("sentence_ids"), sorted_names(0).alias("licenses"), sorted_names(1).alias("kinds"))


def duckdb_sql(documents: str = "documents") -> str:
    """The same result as SQL, but that numbers of lists count as sentences between others."""
    known = ", ".join(f"'{s}': {i}" for i, s in SENTENCES.items())
    ids = lambda pattern: (
        f"list_transform(list_filter(list_transform(string_split_regex(folded, '{pattern}'), lambda s: trim(regexp_replace(s, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))), lambda s: s <> ''), lambda s: coalesce(known[s], 0))"
    )
    found = lambda c: "list_filter([" + ", ".join(f"CASE WHEN contains(sequence, ',{','.join(map(str, r[2]))},') THEN '{r[c]}' END" for r in RULES) + "], lambda s: s IS NOT NULL)"
    return f"""
WITH k AS (SELECT MAP {{{known}}} AS known),
t AS (SELECT doc_id, known, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM {documents}, k),
i AS (SELECT doc_id, {ids(BREAK)} AS lines, {ids(PARAGRAPH)} AS wrapped FROM t),
q AS (SELECT doc_id, list_filter(lines, lambda x: x > 0) AS ids, ',' || array_to_string(lines, ',') || ',' || ',' || array_to_string(wrapped, ',') || ',' AS sequence FROM i)
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct({found(0)})), ',') AS licenses, array_to_string(list_sort(list_distinct({found(1)})), ',') AS kinds
FROM q
"""
