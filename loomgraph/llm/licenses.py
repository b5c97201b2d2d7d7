"""License scans by a positional index of rare words.

The templates are notices of sixteen licences. The corpus gives each of their words, less stop
words, a document frequency, and the RARE highest-IDF words of each template are
the index: word to (template, place). A text that may hold a notice looks up all
its words there; every hit votes for (template, place in text - place in
template). An offset with enough votes is one where the template's words stand
in the right relative places. A template's label holds if, at any such offset,
its key phrase stands exactly where that offset puts it.

Beside that, base phrases are found at every place where their words stand in a
row. Main path: DataFrame functions only, one row in, one row out, no shuffle
but the count of document frequencies.

Nulls and ties. A null text is empty: no words, no labels, score 0. Of a
template's offsets the one with the most votes gives the score. Repeated rows give repeated results; an
empty table gives none. Result columns replace input columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices by label, each with the phrase that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    ("cc-by", "licensed under cc by 4 0", "licensed under cc by 4"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software"),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "be held liable for any damages"),
)
# Words too common to be looked up.
STOP = {"the", "is", "a", "an", "of", "to", "in", "and", "or", "it", "this", "are", "can", "any", "you", "with", "for", "by", "use", "form", "work"}
RARE = 12  # words of a template
AGREE = 0.6
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Runs of digits, ASCII letters and characters beyond ASCII."""
    return F.array_remove(F.split(text, _GAP), "")


def _index() -> list[tuple[str, list[str], dict[str, list[int]], list[str]]]:
    out = []
    for label, text, key in TEMPLATES:
        words = text.split()
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w not in STOP:
                places.setdefault(w, []).append(i)
        out.append((label, words, places, key.split()))
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Documents, and those that hold each word of the index; at most one number a
    word of the templates comes to the driver."""
    vocabulary = sorted({w for _, _, places, _ in _index() for w in places})
    held = F.array_distinct(F.transform(F.filter(split_words(F.col(text_col)), lambda w: F.lower(w).isin(vocabulary)), F.lower))
    # an extra entry counts the documents themselves
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def _at(words: Column, start: Column, phrase: list[str]) -> Column:
    """The phrase stands at start (from 0)."""
    return F.when(start >= 0, F.slice(words, start + 1, len(phrase)) == F.array(*map(F.lit, phrase))).otherwise(F.lit(False))


def _agreement(words: Column, hits: Column, places: dict[str, list[int]], key: list[str], template: list[str]) -> Column:
    """The largest share of the template's rare words that agree on one offset
    where the key phrase is there too, 0 if that is under AGREE. hits: (i, w) of the rare words in the text."""
    where = F.create_map(*(x for w, p in places.items() for x in (F.lit(w), F.array(*map(F.lit, p)))))
    own = F.filter(hits, lambda h: h["w"].isin(list(places)))
    offsets = F.array_sort(F.flatten(F.transform(own, lambda h: F.transform(F.element_at(where, h["w"]), lambda p: h["i"] - p))))
    k = next(i for i in range(len(template)) if template[i : i + len(key)] == key)
    total = min(RARE, sum(map(len, places.values())))
    least = next(n for n in range(1, total + 1) if n / total >= AGREE)
    # in order, an offset with least votes or more is equal to the one least - 1 places on
    enough = F.transform(F.array(offsets), lambda s: F.array_distinct(F.filter(s, lambda o, i: F.get(s, i + (least - 1)) == o)))[0]
    there = F.filter(enough, lambda o: _at(words, o + k, key))
    at = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for w, ps in places.items() for p in ps))
    votes = F.transform(there, lambda o: F.size(F.filter(at, lambda x: F.get(words, o + x["p"]) == x["w"])))
    return F.least(F.lit(1.0), F.coalesce(F.array_max(votes), F.lit(0)) / float(total))


def _base_places(words: Column, phrase: list[str], label: str) -> Column:
    """(i, l) of every place where the phrase's words stand in a row."""
    ends = F.filter(F.transform(words, lambda x, i: F.struct((i - (len(phrase) - 1)).alias("i"), x.alias("w"))), lambda h: h["w"] == phrase[-1])
    return F.transform(F.filter(ends, lambda h: _at(words, h["i"], phrase)), lambda h: F.struct(h["i"].alias("i"), F.lit(label).alias("l")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base (places of base phrases), first_word and last_word
    (least and greatest start, from 0), base_labels, labels (sorted, by commas)
    and score: the best agreement, at least 0.5 with a base label."""
    total, counts = document_frequencies(docs, text_col)
    index = _index()
    vocabulary = sorted({w for _, _, places, _ in index for w in places})
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (-math.log((total + 1) / (counts.get(w, 0) + 1)), w)))}
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    out = docs.drop(*made).withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("n_words", F.size(split_words(F.col("__t"))).cast("long"))
    # every key phrase holds one of these words, so other texts hold no notice
    anchors = sorted({max(key, key=len) for _, _, _, key in index} | {phrase.split()[-1] for phrase, _ in BASE})
    out = out.withColumn("__w", F.when(F.col("__t").rlike("(?i)" + "|".join(anchors)), split_words(F.translate("__t", _UPPER, _LOWER))).otherwise(F.array().cast("array<string>"))).drop("__t")
    w = F.col("__w")
    out = out.withColumn("__h", F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda h: h["w"].isin(vocabulary)))
    rare = [{v: p[v] for v in sorted(p, key=rank.__getitem__)[:RARE]} for _, _, p, _ in index]
    places = [_base_places(w, phrase.split(), label) for phrase, label in BASE]
    out = out.withColumn("__b", F.concat(*places))
    out = out.withColumn("__s", F.array(*(_agreement(w, F.col("__h"), p, key, template) for (_, template, _, key), p in zip(index, rare, strict=True))))
    base = F.array_distinct(F.transform("__b", lambda b: b["l"]))
    labels = F.transform(F.filter(F.arrays_zip(F.col("__s").alias("s"), F.array(*(F.lit(label) for label, *_ in index)).alias("l")), lambda x: x["s"] >= AGREE), lambda x: x["l"])
    best = F.array_max("__s")
    out = out.withColumns(
        {
            "n_base": F.size("__b").cast("long"),
            "first_word": F.array_min(F.transform("__b", lambda b: b["i"])).cast("long"),
            "last_word": F.array_max(F.transform("__b", lambda b: b["i"])).cast("long"),
            "base_labels": F.array_join(F.array_sort(base), ","),
            "labels": F.array_join(F.array_sort(F.array_union(base, labels)), ","),
            "score": F.greatest(F.when(best >= AGREE, best).otherwise(F.lit(0.0)), F.when(F.size("__b") > 0, F.lit(0.5)).otherwise(F.lit(0.0))),
        }
    )
    return out.drop("__w", "__h", "__b", "__s")
