"""License scans, in DataFrame functions alone: sentences, then sequences of sentences.

A text is cut into sentences, each is normalised (lower case, runs of anything but letters and digits become one blank) and
looked up among the known licence sentences. The identifiers found, in order, are matched against licence rules, each a
sequence of identifiers; a rule takes what it matches from the sequence, so the rules' order decides, the longest first.

One map over the texts, without shuffle; only sentences with one of `CLUES` are normalised.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this software is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "licensed under cc by nc 4 0": "cc-by-nc4-short",
    "licensed under cc by 4 0": "cc-by4-short",
    "licensed under cc by sa 4 0": "cc-by-sa4-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-short",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "licensed under the mozilla public license 2 0": "mpl2-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "licensed under the gnu affero general public license version 3": "agpl3-short",
    "see the gnu affero general public license for more details": "agpl-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "licensed under the gnu lesser general public license version 3": "lgpl3-short",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-library-warranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-grant",
    "licensed under the eclipse public license 2 0": "epl2-short",
    "this software is provided as is without any express or implied warranty": "zlib-basis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "bsl1-short",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "licensed under the cc0 1 0 universal license": "cc0-short",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-short",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-short",
    "licensed under cc by nd 4 0": "cc-by-nd4-short",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa4-short",
    "licensed under the bsd 3 clause license": "bsd3-short",
    "licensed under the bsd 2 clause license": "bsd2-short",
    "licensed under the isc license": "isc-short",
    "licensed under the unlicense": "unlicense-short",
    "all rights reserved": "reserved",
}

#: (licence, its sentences in order); tried from the first to the last.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("GPL-3.0-or-later", ("gpl3-later", "gnu-warranty", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later", "gnu-warranty", "gpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-later", "gnu-warranty", "agpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-later", "gnu-library-warranty", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-later", "gnu-library-warranty", "lgpl-see")),
    ("Zlib", ("zlib-basis", "zlib-liable", "zlib-grant")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-short",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-short",)),
    ("CC-BY-4.0", ("cc-by4-short",)),
    ("Unlicense", ("unlicense-domain",)),
    ("Unlicense", ("unlicense-short",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("LGPL-3.0-only", ("lgpl3-short",)),
    ("EPL-2.0", ("epl2-grant",)),
    ("EPL-2.0", ("epl2-short",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-short",)),
    ("0BSD", ("0bsd-grant",)),
    ("CC0-1.0", ("cc0-deed",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-short",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4-short",)),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("ISC", ("isc-short",)),
    ("Proprietary", ("reserved",)),
)

#: Every known sentence has one of these.
CLUES = ("licen", "permi", "redistribut", "copyright", "software", "warrant", "reserved", "mozilla", " mpl ")
_SPLIT = r"[.!?:;]+[\x20\x09-\x0D]+|[.!?:;]+\z|\n[\x20\x09-\x0D]*\n"


def check_rules(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> None:
    """Raises on a sentence that isn't normalised or has no clue, and on a rule with an unknown sentence."""
    for s in sentences:
        if s != re.sub("[^a-z0-9]+", " ", s.lower()).strip() or not any(c in s for c in CLUES):
            raise ValueError(f"not a normalised sentence with a clue: {s}")
    for name, ids in rules:
        if not ids or not set(ids) <= set(sentences.values()):
            raise ValueError(f"unknown sentence in {name}")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, unmatched for each row of docs (doc_id, text).

    n_sentences: known sentences in the text; sentence_ids: their identifiers in order, each in <>; licenses: names of the
    rules that matched, each once, in the rules' order, joined by commas; unmatched: known sentences that no rule took. A
    sentence runs to a stop that white space or the end follows, or to an empty line; a sentence over several lines that
    isn't known as a whole is looked up line by line. Null or empty text: 0 and empty strings. Equal rows give equal rows;
    other columns are not looked at; no rows, no rows.
    """
    check_rules(sentences, rules)
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    clue = "|".join(sorted(c.strip() for c in CLUES))

    def has_clue(s: Column) -> Column:
        return F.lower(s).rlike(clue)

    def lines(s: Column) -> Column:
        found = F.transform(F.filter(F.split(s, "\n"), has_clue), lambda x: F.try_element_at(known, normalised(x)))
        return F.filter(found, lambda x: x.isNotNull())

    def one(s: Column) -> Column:
        whole = F.try_element_at(known, normalised(s))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines(s))

    cut = F.filter(F.split(F.coalesce("text", F.lit("")), _SPLIT), has_clue)
    ids = F.flatten(F.transform(cut, one))
    named = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in own)).alias("own")) for name, own in rules))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["own"])
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["own"], F.lit("|"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    base = docs.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("sentence_ids"))
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("names"))
    matched = base.withColumn("m", F.when(F.col("n_sentences") > 0, F.aggregate(named, start, step)))
    return matched.select("doc_id", "n_sentences", "sentence_ids", F.coalesce(F.array_join(F.array_distinct("m.names"), ","), F.lit("")).alias("licenses"), F.coalesce(F.regexp_count("m.rest", F.lit("<")), F.lit(0)).cast("long").alias("unmatched"))
