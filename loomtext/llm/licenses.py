"""License scans by a positional index of rare words, in column expressions only.

The index maps the rarest words of each license template (by document frequency over the whole corpus, at least
MANDATORY of them from its mandatory phrase) to their postings: the template and the word's position in it. All of
these words are looked up in a file; each occurrence votes for (template, where the template would start in the file), so votes that agree stand at
the right relative positions. A start with enough votes is verified: the template's mandatory phrase must
stand there. The index and the templates are fixed in size; document frequencies are one count per index word.

Null and empty texts have no words, places or labels. Repeated rows get equal results. An empty table gives an empty
result. A very long text is one array of words in its row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import let

#: What stands between words; upper-case ASCII letters count as letters here since the text is not yet lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels (fixed values of the contract).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


class Template(NamedTuple):
    label: str
    text: str
    mandatory: str


#: Notices by which licenses are named or granted and sentences of their texts: label, text, mandatory phrase (fixed
#: values, quoted from the licenses themselves, in the words of `words_of`).
NOTICES = """
mit | released under the mit license | mit license
mit | spdx license identifier mit | license identifier mit
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction | permission is hereby granted free of charge to any person obtaining
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | this permission notice shall be included in all copies
apache-2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | apache license version 2
apache-2 | spdx license identifier apache 2 0 | license identifier apache 2
apache-2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | each contributor hereby grants to you a perpetual worldwide
cc-by-nc | licensed under cc by nc 4 0 | cc by nc
cc-by-nc | creative commons attribution noncommercial 4 0 international | creative commons attribution noncommercial
cc-by-nc-sa | creative commons attribution noncommercial sharealike 4 0 international | attribution noncommercial sharealike
cc-by-nc-nd | creative commons attribution noncommercial noderivatives 4 0 international | attribution noncommercial noderivatives
cc-by-sa | creative commons attribution sharealike 4 0 international | creative commons attribution sharealike
cc-by-sa | licensed under cc by sa 4 0 | cc by sa
cc-by-nd | creative commons attribution noderivatives 4 0 international | creative commons attribution noderivatives
cc-by | creative commons attribution 4 0 international | creative commons attribution 4
cc-by | licensed under cc by 4 0 | cc by 4
cc0 | creative commons cc0 1 0 universal public domain dedication | cc0 1 0 universal
gpl-2 | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license | gnu general public license as published by the free software foundation either version 2
gpl-2 | under the terms of the gnu general public license version 2 | gnu general public license version 2
gpl-3 | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license | gnu general public license as published by the free software foundation either version 3
gpl-3 | this work is licensed under the gnu general public license version 3 | gnu general public license version 3
lgpl | under the terms of the gnu lesser general public license | gnu lesser general public license
lgpl | under the terms of the gnu library general public license | gnu library general public license
agpl-3 | under the terms of the gnu affero general public license as published by the free software foundation either version 3 | gnu affero general public license
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | gnu free documentation license
mpl-1 | the contents of this file are subject to the mozilla public license version 1 1 | mozilla public license version 1
mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla public license v 2
mpl-2 | mozilla public license version 2 0 | mozilla public license version 2
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution and use in source and binary forms
bsd-3 | may be used to endorse or promote products derived from this software without specific prior written permission | endorse or promote products derived from this software
bsd-4 | all advertising materials mentioning features or use of this software must display the following acknowledgement | advertising materials mentioning features or use
isc | permission to use copy modify and or distribute this software for any purpose with or without fee | permission to use copy modify and or distribute
hpnd | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee | distribute and sell this software and its documentation
postgresql | to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | without a written agreement is hereby granted
zlib | in no event will the authors be held liable for any damages arising from the use of this software | in no event will the authors be held liable
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | altered source versions must be plainly marked
boost | distributed under the boost software license version 1 0 | boost software license
boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | any person or organization obtaining a copy of the software
epl-1 | made available under the terms of the eclipse public license v1 0 | eclipse public license v1
epl-2 | made available under the terms of the eclipse public license 2 0 | eclipse public license 2
cddl | subject to the terms of the common development and distribution license | common development and distribution license
eupl | licensed under the european union public licence version 1 2 | european union public licence
ofl | this font software is licensed under the sil open font license version 1 1 | sil open font license
artistic-2 | this is free software under the terms of the artistic license 2 0 | artistic license 2
psf | python software foundation license version 2 | python software foundation license
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | software developed by the openssl project
ncsa | university of illinois ncsa open source license | ncsa open source license
ms-pl | released under the microsoft public license ms pl | microsoft public license
odbl | made available under the open data commons open database license | open database license
unlicense | this is free and unencumbered software released into the public domain | free and unencumbered software
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone is free to copy modify publish
busl | licensed under the business source license 1 1 | business source license
sspl | subject to the terms of the server side public license | server side public license
elastic-2 | licensed under the elastic license 2 0 | elastic license 2
"""
TEMPLATES = tuple(Template(*(part.strip() for part in row.split("|"))) for row in NOTICES.strip().split("\n"))
#: Rarest words of a template that the index holds, how many of them the mandatory phrase has at least, votes needed.
INDEXED, MANDATORY, VOTES = 4, 2, 2


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def template_words() -> list[str]:
    return sorted({w for t in TEMPLATES for w in t.text.split()})


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each template word stands: at most one row a template word reaches the driver."""
    found = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(template_words())))
    counts = docs.select(F.explode(found).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counts.collect()}


def index_of(frequencies: dict[str, int]) -> list[tuple[str, list[tuple[int, int]]]]:
    """Index words, rarest first (ties by code point), each with its postings (template number, position).

    Words that no document has are left out, as they can't vote, unless there are no others at all.
    """
    rarity = lambda w: (frequencies.get(w, 0), w)

    def rarest(words: str) -> list[str]:
        return sorted((w for w in set(words.split()) if frequencies.get(w, 0) > 0 or not any(frequencies.values())), key=rarity)

    chosen = set()
    for t in TEMPLATES:
        phrase = rarest(t.mandatory)[:MANDATORY]
        chosen |= {*phrase, *[w for w in rarest(t.text) if w not in phrase][: INDEXED - len(phrase)]}
    return [
        (w, [(n, at) for n, t in enumerate(TEMPLATES) for at, x in enumerate(t.text.split()) if x == w])
        for w in sorted(chosen, key=rarity)
    ]


def base_starts(words: Column) -> Column:
    """Where base phrases start, as structs (at, label)."""
    split = {p: p.split() for p in PHRASES}
    firsts = sorted({p[0] for p in split.values()})
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())

    def label(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, parts in split.items():
            here = F.lit(True)
            for k, part in enumerate(parts):
                here = here & (F.get(words, i + k) == part)
            found = F.when(F.coalesce(here, F.lit(False)), PHRASES[phrase]).otherwise(found)
        return found

    return F.filter(F.transform(spots, lambda i: F.struct(i.alias("at"), label(i).alias("label"))), lambda s: s["label"].isNotNull())


def voted(words: Column, index: list[tuple[str, list[tuple[int, int]]]]) -> Column:
    """Verified places as structs (label, at, share): share of a template's index words that vote for the place."""
    names = [w for w, _ in index]
    rank = F.create_map(*(F.lit(x) for k, w in enumerate(names) for x in (w, k)))
    postings = F.array(*(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in p)) for _, p in index))
    indexed = [len({w for w in t.text.split()} & set(names)) for t in TEMPLATES]
    seen = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(names), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull()
    )
    ranked = F.transform(seen, lambda s: F.struct(F.element_at(rank, s["w"]).alias("r"), s["i"].alias("i")))

    def look_up(occurrences: Column) -> Column:
        votes = F.flatten(
            F.transform(occurrences, lambda s: F.transform(F.get(postings, s["r"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["at"]).alias("at"))))
        )
        return F.sort_array(votes)

    def verify(votes: Column) -> Column:
        """votes are sorted, so those that agree lie together: a run's length is the next run's start less its own."""
        begins = F.filter(F.transform(votes, lambda v, k: F.when((k == 0) | (F.get(votes, k - 1) != v), k)), lambda k: k.isNotNull())

        def runs(starts: Column) -> Column:
            length = lambda k, j: F.coalesce(F.get(starts, j + 1), F.size(votes)) - k
            return F.transform(starts, lambda k, j: F.struct(F.get(votes, k).alias("v"), length(k, j).alias("hits")))

        agreed = F.filter(let(begins, runs), lambda r: r["hits"] >= VOTES)

        def place(run: Column) -> Column:
            v = run["v"]
            size = F.get(F.array(*(F.lit(len(t.text.split())) for t in TEMPLATES)), v["t"])
            passage = F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(v["at"], F.lit(0)) + 1, size + F.least(v["at"], F.lit(0))), " "), F.lit(" "))
            mandatory = F.get(F.array(*(F.lit(f" {t.mandatory} ") for t in TEMPLATES)), v["t"])
            share = F.least(F.lit(1.0), run["hits"].cast("double") / F.get(F.array(*map(F.lit, indexed)), v["t"]))
            label = F.get(F.array(*(F.lit(t.label) for t in TEMPLATES)), v["t"])
            return F.when(F.contains(passage, mandatory), F.struct(label.alias("label"), v["at"].alias("at"), share.alias("share")))

        return F.filter(F.transform(agreed, place), lambda s: s.isNotNull())

    return let(let(ranked, look_up), verify)


def promising(words: Column) -> Column:
    """Whether any mandatory phrase stands among the words: no place can be verified without one, so other texts don't vote."""
    phrases = "|".join(sorted({t.mandatory for t in TEMPLATES}))  # letters, digits and single spaces alone
    return F.array_join(words, " ").rlike(f"(?:^| )(?:{phrases})(?: |$)")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column `_license`: n_words, base places and the method's verified places."""
    index = index_of(document_frequencies(docs, text))

    def scan(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            base_starts(words).alias("base"),
            F.when(promising(words), voted(words, index)).otherwise(F.array().cast("array<struct<label: string, at: int, share: double>>")).alias("found"),
        )

    return docs.withColumn("_license", let(words_of(F.col(text)), scan))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What query op9 returns. score: 1 with a base phrase, else the best share of votes of a verified place, else 0."""
    found = scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "_license")
    base, method = F.col("_license.base"), F.col("_license.found")
    at = F.transform(base, lambda s: s["at"])
    labels = lambda a: F.transform(a, lambda s: s["label"])
    return found.select(
        "doc_id",
        F.col("_license.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels(base))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels(base), labels(method)))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(method, lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )
