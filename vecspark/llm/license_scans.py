"""License scans over a positional rare-token index.

The index is built from the notices below, short statements and the operative passages of licence texts: of each notice
the POSTINGS positions whose words have the highest IDF over all notices, by word. Common words are not in it, so what
is looked up of a file are its highest-IDF licence words, at all their places. Each posting votes for the start (file
position - notice position), so postings of one notice intersect by relative position. Starts with enough votes are
verified: the notice's mandatory key phrase must stand at its place. All of it is one projection over the table: no
shuffle and no Python.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases counted as base places, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice, mandatory key phrase (part of the notice).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "licensed under cc by 4 0"),
    ("cc", "licensed under a creative commons attribution license", "creative commons attribution license"),
    ("cc0", "creative commons public domain dedication cc0 1 0 universal license", "cc0 1 0 universal license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed on an as is basis"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute sublicense and or sell copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", "redistributions of source code must retain the above copyright notice"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "source code form is subject to the terms of the mozilla public license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("zlib", "this notice may not be removed or altered from any source distribution altered source versions must be plainly marked as such zlib license", "altered source versions must be plainly marked as such zlib license"),
    ("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", "want to public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain unlicense", "free and unencumbered software"),
]
#: Every base phrase and mandatory phrase holds one of these, so texts without any have no label.
HINTS = ("licens", "hereby", "redistribution", "unencumbered")
POSTINGS = 12
MIN_VOTES = 0.6
SHIFT = 1 << 40


def index() -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (notice, position) of each indexed word, and the number of postings of each notice."""
    texts = [notice.split() for _, notice, _ in NOTICES]
    df = Counter(w for words in texts for w in set(words))
    idf = {w: math.log(len(NOTICES) / n) for w, n in df.items() if re.search(r"[a-z]{2}", w)}
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for no, words in enumerate(texts):
        ranked = sorted((at for at, w in enumerate(words) if idf.get(w, 0) > 0), key=lambda at: (-idf[words[at]], at))[:POSTINGS]
        sizes.append(len(ranked))
        for at in sorted(ranked):
            postings.setdefault(words[at], []).append((no, at))
    return postings, sizes


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty: no words, no labels, score 0. Repeated rows are scanned each for itself. The score is
    the largest share of a verified notice's postings that voted, 1 for a base phrase, else 0. Further columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    postings, sizes = index()
    none = F.array().cast("array<bigint>")
    df = docs.select(F.col(id_col), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    hinted = F.lit(False)
    for h in HINTS:
        hinted = hinted | F.col("_low").contains(h)
    df = df.select(id_col, F.regexp_extract_all("_low", F.lit(WORD), F.lit(0)).alias("_w"), hinted.alias("_hinted"))

    w = lambda i: F.get(F.col("_w"), i)  # noqa: E731  words from 0, null beyond the ends

    def starts(phrase: str) -> Column:
        """Places of a base phrase, found from its last word."""
        words = phrase.split()

        def here(x: Column, i: Column) -> Column:
            ok = (x == words[-1]) & (i >= len(words) - 1)
            for back, v in enumerate(reversed(words[:-1]), 1):
                ok = ok & (w(i - back) == v)
            return F.when(ok, i - (len(words) - 1)).otherwise(-1).cast("bigint")

        return F.filter(F.transform("_w", here), lambda s: s >= 0)

    lists = {label: F.when(F.col("_hinted"), starts(p)).otherwise(none) for p, label in BASE.items()}
    # votes: notice * SHIFT + start, start moved up so that it is never negative
    longest = max(len(n.split()) for _, n, _ in NOTICES)
    table = F.create_map(*(x for word, ps in postings.items() for x in (F.lit(word), F.lit([no * SHIFT + longest - at for no, at in ps]).cast("array<bigint>"))))
    voted = F.flatten(F.transform(F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.cast("bigint").alias("i"))), lambda s: s["x"].isin(list(postings))), lambda s: F.transform(F.element_at(table, s["x"]), lambda p: p + s["i"])))
    df = df.select(id_col, "_w", "_hinted", *(x.alias(f"_{k}") for k, x in lists.items()), F.when(F.col("_hinted"), F.array_sort(voted)).otherwise(none).alias("_v"))
    # the votes are sorted: the places where a new (notice, start) begins give the counts
    v = F.col("_v")
    begins = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (F.get(v, i - 1) != x), i).otherwise(-1)), lambda i: i >= 0)
    df = df.select("*", F.when(F.size(v) > 0, begins).otherwise(F.array().cast("array<int>")).alias("_b"))
    b = F.col("_b")
    cands = F.transform(b, lambda i, k: F.struct(F.get(v, i).alias("key"), (F.coalesce(F.get(b, k + 1), F.size(v)) - i).alias("n")))
    need = F.lit([math.ceil(MIN_VOTES * n) for n in sizes])
    no = lambda c: F.floor(c["key"] / SHIFT).cast("int")
    cands = F.filter(cands, lambda c: c["n"] >= F.element_at(need, no(c) + 1))
    phrases = F.lit([p.split() for _, _, p in NOTICES])
    where = F.lit([notice.split().index(p.split()[0]) if notice.startswith(p) or (" " + p) not in notice else len(notice[: notice.index(" " + p)].split()) for _, notice, p in NOTICES])

    def verified(c: Column) -> Column:
        phrase = F.element_at(phrases, no(c) + 1)
        at = (F.pmod(c["key"], F.lit(SHIFT)) - longest + F.element_at(where, no(c) + 1)).cast("int")
        return (at >= 0) & (F.slice(F.col("_w"), F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)

    df = df.select("*", F.filter(cands, verified).alias("_c"))
    names, size = F.lit([n for n, _, _ in NOTICES]), F.lit(sizes)
    all_starts = F.concat(*(F.col(f"_{k}") for k in BASE.values()))
    base = F.array_compact(F.array(*(F.when(F.size(f"_{k}") > 0, k) for k in BASE.values())))
    added = F.transform("_c", lambda c: F.element_at(names, no(c) + 1))
    best = F.array_max(F.transform("_c", lambda c: c["n"] / F.element_at(size, no(c) + 1)))
    score = F.when(F.size(all_starts) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))))
    return df.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).alias("first_word"),
        F.array_max(all_starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        score.alias("score"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
