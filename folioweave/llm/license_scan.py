"""License scan over a positional index of rare words.

The index holds, for each license template, its rarest words by document frequency over the
whole corpus, with their places in the template. A file looks up every such word that it
holds. Each lookup names a template and the place where it would start; a place counts if
enough of the template's rare words, weighed by rarity, stand at their places relative to it,
and if its mandatory key phrases do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, once

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that may be added or left out between one key phrase and the next; a template that is one phrase stands exactly.
SLACK = 4
#: Rare words of a template that are posted, and the share of them, by weight, that must stand in their places.
RARE_WORDS, LEAST_SHARE = 8, 0.5
#: A place is coded in a long: its template above, its start below, moved so that none is negative.
PLACE_BITS, MOVED = 40, 1 << 10


@dataclass(frozen=True)
class Template:
    """A license's wording. Each of ``keys`` is part of ``text`` and must stand word for word, up to SLACK words beside its place after the key before; base templates are reported by place."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        found = []
        for key in self.keys or (self.text,):
            k = key.split()
            found.append((next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k))
        return found


#: The dealt base phrases, and well-known wording of public licenses.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("you can redistribute it and or modify it under the terms of the gnu general public license",)),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Template("bsd", "bsd 2 clause"),
    Template("bsd", "bsd 3 clause"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("boost", "boost software license"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("proprietary", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("to deal in the software without restriction", "shall be included in all copies or substantial portions of the software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "the author disclaims all warranties with regard to this software")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("in no event will the authors be held liable", "alter it and redistribute it freely")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("as published by the free software foundation", "in the hope that it will be useful but without any warranty")),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("licensed under the apache license version 2 0", "distributed on an as is basis without warranties or conditions of any kind")),
)


def words_of(text: Column) -> Column:
    """Lower-cased words; splitting is several times faster than extracting them."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """For each word of the templates, the documents that hold it; and the number of documents. A row for each word reaches the driver."""
    own = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    rows = docs.select(F.explode(F.array_append(own, F.lit(" "))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    return found, found.pop(" ", 0)


def _rarest(words: list[str], idf: dict[str, float], most: int) -> list[int]:
    """Places of the rarest distinct words, the first place of each."""
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    return [first[w] for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:most]]


def posted_places(t: Template, idf: dict[str, float], rare_words: int) -> tuple[list[int], list[int]]:
    """Places of a template's rare words, which vote; and those that are posted, with the rarest word of the first key phrase, so that no place is missed."""
    rare = _rarest(t.words, idf, rare_words)
    start, key = t.key_places()[0]
    return rare, sorted({*rare, start + _rarest(key, idf, 1)[0]})


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare_words: int = RARE_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places for every row of docs.

    A place is (label, base, at): a template's own start, as its first key phrase puts it, whose
    key phrases were verified. Its votes are those of the ``rare_words`` rarest words of the
    template, by IDF over all documents, that stand where it puts them, as far beside as key
    phrases may. A place needs ``least_share`` of the IDF of all of them; ``score`` is the
    greatest share. All rare words of a file are looked up, none is capped, and the first key
    phrase's rarest word is always posted, so no place is missed. A null or empty text has no
    words and score 0; repeated rows are scanned each; an empty table gives no rows. No row is
    shuffled but for the counts of words.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    seen, n = document_frequencies(docs, vocabulary)
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in vocabulary}

    postings: dict[str, set[int]] = {}
    rare: list[list[tuple[int, str, float]]] = []
    for number, t in enumerate(templates):
        voting, posted = posted_places(t, idf, rare_words)
        rare.append([(p, t.words[p], idf[t.words[p]]) for p in voting])
        for p in posted:
            # What a word's own number in the file must be added to, to name the place.
            postings.setdefault(t.words[p], set()).add((number << PLACE_BITS) + MOVED - p)

    index = F.create_map(*[x for w, found in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(x).cast("long") for x in sorted(found)]))])
    words = F.col("words")

    def as_data(number: int, t: Template) -> Column:
        """A template as a literal: its key phrases, its voting words, and how far they may stand beside."""
        slack = SLACK if t.keys else 0
        keys = [F.struct(F.lit(start).alias("p"), F.lit(len(key)).alias("n"), F.lit(" ".join(key)).alias("phrase"), F.sequence(F.lit(-k * slack), F.lit(k * slack)).alias("beside")) for k, (start, key) in enumerate(t.key_places())]
        votes = [F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(x).alias("x")) for p, w, x in rare[number]]
        wide, total = max(1, len(t.keys) - 1) * slack, sum(x for _, _, x in rare[number])
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(slack).alias("slack"), F.array(*keys).alias("keys"), F.array(*votes).alias("votes"), F.sequence(F.lit(-wide), F.lit(wide)).alias("beside"), F.lit(total).alias("total"))

    known = F.array(*[as_data(number, t) for number, t in enumerate(templates)])

    def verified(place: Column) -> Column:
        """Null if a key phrase is missing, else label, base, at and score."""
        t = F.get(known, F.shiftright(place, PLACE_BITS).cast("int"))
        at = (place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) - MOVED).cast("int")

        def judged(x: Column) -> Column:
            t, at = x["t"], x["at"]
            stands = lambda k, from_: (from_ >= 0) & (F.array_join(F.slice(words, F.greatest(from_, F.lit(0)) + 1, k["n"]), " ") == k["phrase"])
            # Words left out before the first key phrase may put the start before the file's own.
            ok = (at >= -t["slack"]) & F.forall(t["keys"], lambda k: F.exists(k["beside"], lambda d: stands(k, at + k["p"] + d)))
            voted = lambda v: F.exists(t["beside"], lambda d: F.coalesce(F.get(words, at + v["p"] + d) == v["w"], F.lit(False)))
            share = F.least(F.aggregate(t["votes"], F.lit(0.0), lambda s, v: s + F.when(voted(v), v["x"]).otherwise(0.0)) / t["total"], F.lit(1.0))
            return F.when(ok, F.struct(t["label"].alias("label"), t["base"].alias("base"), F.greatest(at, F.lit(0)).cast("long").alias("at"), share.alias("score")))

        # An array of one binds both, which would else be computed at each use.
        return F.get(F.transform(F.array(F.struct(t.alias("t"), at.alias("at"))), judged), F.lit(0))

    read = once(docs.select("doc_id", "text"), words=words_of(F.col("text"))).drop("text")
    looked_up = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted(postings)), i)), lambda i: i.isNotNull())
    named = F.array_distinct(F.flatten(F.transform(looked_up, lambda i: F.transform(F.element_at(index, F.get(words, i)), lambda p: p + i))))
    places = F.filter(F.transform(named, verified), lambda x: x.isNotNull() & (x["base"] | (x["score"] >= least_share)))
    placed = once(read, n_words=F.size("words").cast("long"), places=places).drop("words")
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["at"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    return placed.select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        "places",
    )
