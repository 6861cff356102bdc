"""License scan by a positional index of words weighted by rarity.

Templates are usual notices and the operative words of licences, with mandatory key phrases. The index holds,
for every template word, its templates, its offset there and its IDF from the
collection's own document frequencies, so common words weigh little but are not left
out. The key phrases that stand in a file propose its templates, as none counts
without. Each of the file's words votes for (template, position - offset) in all that
are proposed, and the votes that agree on one relative position give the template's
coverage. A template counts where its coverage is high enough.

DataFrame functions only. The driver sees the template vocabulary's document
counts, one number for each template word, and nothing that grows with the data.

Defined results: a null or wordless text has no words, no labels and score 0; a
repeated row is scanned as any other; an empty table gives an empty result; input
columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that give a label wherever their words stand consecutively.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label, words of a usual notice, mandatory key phrases.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "released under the cc0 public domain dedication", ("cc0",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "either version 3 of the license or at your option any later version", ("any later version",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("proprietary", "copyright all rights reserved", ("all rights reserved",)),
    # The operative words of public licences, and the notices that their texts ask for, in their own order.
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("redistribution and use",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify",),
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("apache license", "in compliance with the license"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("gnu general public license", "any later version"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license "
        "or at your option any later version",
        ("lesser general public license",),
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
        "to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software",),
    ),
    (
        "bsl",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software",
        ("boost software license",),
    ),
)
#: Share of a template's weight that must agree on one position.
COVERAGE = 0.6
#: Score of a file where only a base phrase stands.
BASE_SCORE = 0.5


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text: Column) -> Column:
    """The words of a text, each between single spaces: ``" a b "``; ``" "`` if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), SEPARATORS, " ")


def _spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def _first(phrase: str) -> Column:
    """Word index of the phrase's first place; null if it is nowhere."""
    at = F.instr(F.col("line"), f" {phrase} ")
    return F.when(at > 0, _spaces(F.substring(F.col("line"), F.lit(1), at - 1)))


def _last(phrase: str) -> Column:
    back = F.instr(F.col("back"), f" {phrase} "[::-1])
    return F.when(back > 0, F.col("n_words") - _spaces(F.substring(F.col("back"), F.lit(1), back - 1)) - len(phrase.split()))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _vocabulary() -> list[str]:
    return sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def _gate() -> str:
    """A pattern for texts that may hold a base or key phrase: its longest word, in any case."""
    phrases = [*BASE, *(k for _, _, keys in TEMPLATES for k in keys)]
    return "(?i)" + "|".join(sorted({max(p.split(), key=len) for p in phrases}))


def weights(docs: DataFrame) -> dict[str, float]:
    """IDF of the template words over all texts of ``docs``; always positive."""
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary()])
    words = F.array_intersect(vocabulary, F.split(lowered(F.col("text")), SEPARATORS))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("word"))
    # The empty word is added once to every document, so it counts them.
    df = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    docs_seen = df.pop("", 0)
    return {w: math.log(1 + (1 + docs_seen) / (1 + df.get(w, 0))) for w in _vocabulary()}


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text): words, places of base phrases, labels and score, one row for each row.

    A file without a key phrase has one narrow row from the start; only the
    hits of the others are grouped, by row, so nothing of a text is shuffled.
    """
    idf = weights(docs)
    # The row number also keeps Spark from working out the words anew in every later expression.
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    lines = docs.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.when(F.rlike(F.col("text"), F.lit(_gate())), normal(F.col("text"))).otherwise(" ").alias("line"),
        F.monotonically_increasing_id().alias("row"),
    )
    hot = F.col("line").contains("license")
    counts = {label: F.when(hot, F.regexp_count("line", F.lit(f" {phrase}(?= )"))).otherwise(0) for phrase, label in BASE.items()}
    rows = (
        lines.withColumn("back", F.when(hot, F.reverse("line")))
        .withColumns(
            {
                "n_base": sum(counts.values(), F.lit(0)).cast("long"),
                "first_word": F.least(*[F.when(hot, _first(p)) for p in BASE]).cast("long"),
                "last_word": F.greatest(*[F.when(hot, _last(p)) for p in BASE]).cast("long"),
                "base": F.array_sort(F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for label, c in counts.items()]))),
                # Templates whose key phrases stand.
                "proposed": F.array_compact(F.array(*[F.when(_all([F.contains(F.col("line"), F.lit(f" {k} ")) for k in keys]), F.lit(i)) for i, (_, _, keys) in enumerate(TEMPLATES)])),
            }
        )
        .drop("back")
    )
    carried = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]

    postings = [(i, w, at, idf[w]) for i, (_, words, _) in enumerate(TEMPLATES) for at, w in enumerate(words.split())]
    total = [sum(v for j, _, _, v in postings if j == i) for i in range(len(TEMPLATES))]
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary()])
    index = docs.sparkSession.createDataFrame(postings, "template int, word string, offset int, idf double")
    coverage = F.col("got") / F.get(F.array(*[F.lit(float(t)) for t in total]), F.col("template"))
    kept = [F.first(c).alias(c) for c in carried]
    hit = (F.col("word") == F.col("at_word")) & F.array_contains("proposed", F.col("template"))
    judged = (
        rows.select("row", *carried, "proposed", F.posexplode_outer(F.when(F.size("proposed") > 0, F.split("line", " "))).alias("pos", "word"))
        # Every line begins with an empty word, so a file whose words hit nothing keeps a row.
        .where(F.col("word").isNull() | (F.col("pos") == 0) | F.array_contains(vocabulary, F.col("word")))
        .join(F.broadcast(index.withColumnRenamed("word", "at_word")), hit, "left")  # as many rows as the templates have words
        .where(F.col("template").isNotNull() | F.col("word").isNull() | (F.col("pos") == 0))
        .drop("proposed")
        .groupBy("row", "template", (F.col("pos") - F.col("offset")).alias("shift"))
        .agg(F.sum("idf").alias("got"), *kept)
        .groupBy("row", "template")
        .agg(F.max("got").alias("got"), *kept)
        .withColumn("vote", F.when(coverage >= COVERAGE, F.struct("template", coverage.alias("coverage"))))
        .groupBy("row")
        .agg(F.collect_list("vote").alias("votes"), *kept)
        .select(*carried, "votes")
    )
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    own = F.transform("votes", lambda v: F.get(labels, v["template"]))
    best = F.coalesce(F.array_max(F.transform("votes", lambda v: v["coverage"])), F.lit(0.0))
    return judged.select(
        *carried[:-1],
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0))).alias("score"),
    )
