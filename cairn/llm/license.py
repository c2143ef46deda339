"""License scans: a trained paragraph classifier names license families, template comparison confirms them.

A paragraph is what blank lines enclose, of any number of lines. In it lines, or two lines of which neither is recognised alone
(wrapped text), go through the classifier: a multinomial logistic regression over which word 1-grams and 2-grams they hold. It
is trained on names of licenses in phrases by which licenses are granted, on sentences of their texts, and as `unknown` on
sentences near the subject that grant nothing and on the same names in phrases that tell of a license or deny it. Its
probabilities are tempered so that held-out rows are neither over- nor underconfident (see calibration()), and a family
under the acceptance level counts as unknown.

The whole paragraph is compared with templates, the sentences of license texts: by the share of a template's word 3-grams that
it holds, wherever its lines break. A family so found is confirmed, as is a line that holds all words of one of the family's
names or enough of one of its sentences. A paragraph names each family once.

The model is small (its features come from the training sentences) and reaches the texts as a literal; scanning uses built-in
functions only. Only lines with one of the anchor words are scored: all other features together cannot lift a family to the
acceptance level, so nothing is lost (see Model.anchors). Paragraphs are compared with templates where they hold one of the
templates' marks, without which none holds enough of one (see template_marks()).
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import let, table
from cairn.llm.private import running

#: Names of licenses, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("gnu affero general public license", "gnu affero general public license version 3", "agpl 3.0", "agpl v3", "agpl 3.0 or later"),
    "apache": ("apache license", "apache license version 2.0", "apache 2.0", "apache license 2.0"),
    "artistic": ("artistic license", "artistic license 2.0", "artistic 2.0", "perl artistic license"),
    "boost": ("boost software license", "boost software license version 1.0", "bsl 1.0"),
    "bsd": ("bsd license", "bsd 3 clause license", "bsd 2 clause", "bsd 3 clause", "new bsd license", "simplified bsd license", "3 clause bsd license"),
    "cc": ("creative commons attribution license", "creative commons attribution noncommercial 4.0 international license", "creative commons attribution sharealike 3.0 license", "cc by nc 4.0", "cc by sa 3.0", "cc by 4.0", "cc by nd 4.0", "creative commons attribution 4.0 international license"),
    "cc0": ("cc0", "cc0 1.0 universal", "creative commons zero", "cc0 1.0 public domain dedication"),
    "cddl": ("common development and distribution license", "cddl 1.0", "cddl version 1.1"),
    "epl": ("eclipse public license", "eclipse public license v 2.0", "epl 2.0", "eclipse public license version 1.0"),
    "eupl": ("european union public licence", "european union public license v 1.2", "eupl 1.2", "eupl", "eupl v1.1"),
    "gpl": ("gnu general public license", "gnu general public license version 3", "gnu general public license version 2", "gpl version 2 or any later version", "gpl 3.0 or later", "gplv3", "gpl v2", "gnu gpl"),
    "isc": ("isc license", "isc"),
    "lgpl": ("gnu lesser general public license", "gnu lesser general public license version 2.1", "gnu library general public license", "lgpl 2.1", "lgpl v3", "lgpl 3.0 or later"),
    "mit": ("mit license", "mit", "expat license", "mit expat license"),
    "mpl": ("mozilla public license", "mozilla public license version 2.0", "mpl 2.0", "mpl 1.1"),
    "mspl": ("microsoft public license", "ms pl", "microsoft public license ms pl"),
    "odbl": ("open database license", "odbl 1.0", "open data commons open database license"),
    "ofl": ("sil open font license", "sil open font license version 1.1", "ofl 1.1"),
    "postgresql": ("postgresql license", "the postgresql licence"),
    "unlicense": ("unlicense", "the unlicense"),
    "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
    "zlib": ("zlib license", "zlib libpng license", "zlib"),
}
#: Sentences of license texts and notices, by family.
SENTENCES: dict[str, tuple[str, ...]] = {
    "agpl": ("you can redistribute it and or modify it under the terms of the gnu affero general public license",),
    "apache": ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "cc": ("this work is licensed under a creative commons attribution license",),
    "cc0": ("to the extent possible under law the author has dedicated all copyright and related rights to the public domain worldwide",),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license",),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license version 2.0",),
    "mspl": ("each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution prepare derivative works of its contribution",),
    "ofl": ("this font software is licensed under the sil open font license",),
    "postgresql": ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",),
    "proprietary": (
        "all rights reserved",
        "copyright all rights reserved no part may be reproduced without written permission",
        "this software is proprietary and confidential unauthorized copying is prohibited",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
}
#: Phrases by which a license is named. The last are held out of training, to calibrate on.
PHRASES = (
    "licensed under the {}", "released under the {}", "distributed under the {}", "this work is licensed under the {}", "spdx license identifier {}", "available under the terms of the {}",
    "this project uses the {}", "code is under {}", "license {}", "published under {}", "{}", "licensed under {}",
)
HELD_OUT_PHRASES = ("subject to the {} see the file", "you may use it under the conditions of the {}", "our sources are {} licensed", "made public under the {}")
#: Phrases that tell of a license, or deny it, and grant nothing. The last are held out.
NARRATIVE = (
    "this article is about the history of the {}", "the {} is not used here", "this code is not licensed under the {}", "the {} was written by a foundation", "an article about the {} and its authors", "we do not use the {} for this project",
    "no part of it is under the {}", "the {} does not apply to this work", "the history of the {} began in the year", "critics of the {} said that it was long", "he wrote a book about the {}", "she compared the {} with others in a talk",
    "unlike the {} our terms are not free", "the {} was first published by a university", "what is the {} and why was it made", "it was never released under the {}", "this is no longer licensed under the {}", "a court ruled on the {} last year",
    "our work is not licensed under the {}", "it is not released under the {}", "they are not distributed under the {}", "nothing here is licensed under the {}", "not available under the {}", "does not use the {}", "the article tells of the {}", "a talk about the {} was given", "discussed by lawyers", "the debate about the {} went on", "lawyers discussed the {} at length", "an essay on how the {} was written", "the {} is one of many licenses", "the {} is compared with other licenses below", "all code is proprietary and not under the {}",
)
HELD_OUT_NARRATIVE = ("the article tells the history of the {} by its authors", "this project is not under the {}", "a book on the {} was written last year", "the {} was discussed by lawyers and critics", "it does not use the {}")
#: Sentences near the subject that grant nothing; the last are held out.
UNKNOWN = (
    "he lost his driving license in the city", "the license number is on the back of the card", "a public version of the work is free to use in the forms",
    "the general said that the public may not use the copy", "this file is part of the source", "the terms of the contract were later made public",
    "software is sold under many names", "you can use this program with or without the source", "the mit is a university in cambridge",
    "apache is the name of a people", "the commons met in the house", "mozilla made a browser", "the original work was reserved for later", "a person may be granted a copy free of charge",
    "the license of the pub was renewed", "please see the license", "version 2.0 of the game", "the rights of all are the same", "copyright is a matter of law",
    "the union of european states", "the eclipse of the sun was public", "an artistic work of the time", "a boost of sales by the software", "the library is open to the general public",
    "the database of the city is open", "the font was used in the book", "a development of common land", "permission was granted by the author", "the warranty of the car is implied",
    "no damages were claimed", "zlib is a library by two authors", "gnu is an animal", "the perl of the sea", "the international fair of attribution",
)
HELD_OUT_UNKNOWN = ("the mit press released the book", "the license to sell was reserved", "a general public holiday", "the apache tribe was under attack", "all copies of the book are sold", "the software library of the university", "creative people of the commons", "his rights under the contract")
#: Variations of each sentence and of each name in a phrase that grants, training steps and rate, weight decay, level for acceptance, the share of a sentence's words
#: that confirms it.
VARIATIONS, GRANTS, STEPS, RATE, DECAY, ACCEPT, CONFIRM = 20, 6, 300, 2.0, 5e-5, 0.5, 0.6
#: Words that tell nothing alone or next to each other.
COMMON = frozenset(
    "a above all and any anyone are as at be by for from has he held his if in into is it its later may must new of on or our own see shall so that the their they this to under used uses was were will "
    "with without you your 0 1 2 3 4 1.0 2.0".split()
)
_WORDS = "[^a-z0-9]+"
#: Between two paragraphs: the end of a line before a blank one.
_BLANK = r"\n[ \t\r\f\x0B]*(?=\n)"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_WORDS, text.lower()) if w]


def features_of(words: list[str]) -> set[str]:
    """1-grams and 2-grams, without those of common words only."""
    found = {(w,) for w in words} | set(zip(words, words[1:], strict=False))
    return {" ".join(f) for f in found if not COMMON.issuperset(f)}


def templates() -> list[tuple[str, list[str]]]:
    """(family, 3-grams) of each sentence of a license text that has enough words to tell."""
    out = []
    for family, sentences in sorted(SENTENCES.items()):
        for sentence in sentences:
            words = words_of(sentence)
            if len(words) >= 8:
                out.append((family, sorted({" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)})))
    return out


def template_marks() -> list[str]:
    """Words one of which every paragraph holds that holds enough of a template.

    Of each template the longest words, until fewer 3-grams are free of them than a paragraph must hold.
    """
    taken: set[str] = set()
    for _, grams in templates():
        free, least = [g for g in grams if taken.isdisjoint(g.split())], math.ceil(CONFIRM * len(grams))
        while len(free) >= least:
            taken.add(min({w for g in free for w in g.split()}, key=lambda w: (-len(w), w)))
            free = [g for g in free if taken.isdisjoint(g.split())]
    return sorted(taken)


class Model(NamedTuple):
    families: list[str]  # the last is unknown
    weights: dict[str, list[float]]  # by feature, a logit for each family
    bias: list[float]
    temperature: float
    #: Of held-out rows: how many, how many named right, and the mean gap between probability and that (by tenths).
    held_out: tuple[int, float, float]

    def anchors(self) -> list[str]:
        """Words one of which every accepted paragraph holds.

        Features count once, and a 2-gram counts with its words: so without the anchors a family can gain on unknown at
        most the sum of what the features free of anchors give it. Words are taken as anchors, largest gain first, until
        for every family that sum stays under what acceptance needs.
        """
        unknown = len(self.families) - 1
        free = {f: np.maximum(np.array(w[:-1]) - w[unknown], 0) for f, w in self.weights.items()}
        base = np.array(self.bias[:-1]) - self.bias[unknown]
        taken: list[str] = []
        while True:
            total = base + sum(free.values(), np.zeros(unknown))
            if (total < self.temperature * math.log(ACCEPT / (1 - ACCEPT))).all():
                return taken
            worst, gains = int(total.argmax()), {}
            for f, g in free.items():
                for w in set(f.split()) - COMMON:  # every feature holds one
                    gains[w] = gains.get(w, 0.0) + g[worst]
            best = max(sorted(gains), key=gains.__getitem__)
            taken.append(best)
            free = {f: g for f, g in free.items() if best not in f.split()}


def _varied(sentence: str, rng: random.Random, filler: list[str]) -> str:
    """A sentence with words dropped and words around it."""
    words = [w for w in words_of(sentence) if rng.random() > 0.04]
    before, after = rng.randint(0, 3), rng.randint(0, 6)
    return " ".join([*rng.choices(filler, k=before), *words, *rng.choices(filler, k=after)])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def one_of(words: list[str]) -> str:
    """A pattern of any of the words, alike beginnings together, so that most places are left at their first letter."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words):
        groups.setdefault(w[0], []).append(w[1:])
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in groups.items()) + r")(?![a-z0-9])"


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, by gradient descent on the training sentences; the same each time."""
    rng = random.Random(3)
    filler = sorted({w for s in UNKNOWN for w in words_of(s)} | {"copyright", "2020", "2021", "see", "file", "under", "project", "code", "text"})
    families = [*sorted({*NAMES, *SENTENCES}), "unknown"]
    rows: list[tuple[set[str], int, bool]] = []

    def add(sentence: str, k: int, held: bool, times: int) -> None:
        rows.extend((features_of(words_of(_varied(sentence, rng, filler))), k, held) for _ in range(times))

    for k, family in enumerate(families[:-1]):
        for name in NAMES.get(family, ()):
            for phrases, held in ((PHRASES, False), (HELD_OUT_PHRASES, True)):
                for phrase in phrases:
                    add(phrase.format(name), k, held, 2 if held else GRANTS)
        for sentence in SENTENCES.get(family, ()):
            add(sentence, k, False, VARIATIONS)
            add(sentence, k, True, 4)
        for name in NAMES.get(family, ()):
            for phrases, held in ((NARRATIVE, False), (HELD_OUT_NARRATIVE, True)):
                for phrase in phrases:
                    add(phrase.format(name), len(families) - 1, held, 1)
    for sentence in UNKNOWN:
        add(sentence, len(families) - 1, False, VARIATIONS)
    for sentence in HELD_OUT_UNKNOWN:
        add(sentence, len(families) - 1, True, VARIATIONS)
    rows += [(features_of(rng.choices(filler, k=rng.randint(1, 12))), len(families) - 1, rng.random() < 0.25) for _ in range(1_000)]
    seen = [*UNKNOWN, *NARRATIVE, *(p.format(x) for names in NAMES.values() for x in names for p in PHRASES), *(x for s in SENTENCES.values() for x in s)]
    names = sorted({f for s in seen for f in features_of(words_of(s))})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for r, (found, _, _) in enumerate(rows):
        x[r, [place[f] for f in found if f in place]] = 1
    y, held = np.eye(len(families), dtype=np.float32)[[k for _, k, _ in rows]], np.array([h for _, _, h in rows])
    w = np.zeros((len(names) + 1, len(families)), np.float32)
    w[-1, -1] = 1.0
    own, target = x[~held], y[~held]
    for _ in range(STEPS):
        w -= RATE * (own.T @ (_softmax(own @ w) - target) / len(own) + DECAY * w)
    z, right = x[held].astype(float) @ w, y[held].argmax(axis=1)

    def loss(t: float) -> float:
        return float(-np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean())

    temperature = min((math.exp(k / 20) for k in range(-40, 41)), key=loss)
    p = _softmax(z / temperature)
    sure, hit = p.max(axis=1), p.argmax(axis=1) == right
    tenth = np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs(sure[tenth == k].sum() - hit[tenth == k].sum()) for k in range(10)) / len(hit)
    w = np.where(np.abs(w) < 0.02, 0, w.astype(float)).round(3)
    return Model(families, {f: w[k].tolist() for f, k in place.items() if w[k].any()}, w[-1].tolist(), temperature, (len(hit), float(hit.mean()), float(gap)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with licenses: array of (paragraph, family, probability, confirmed) of what paragraphs say, each family once in each.

    paragraph is the number of the line where it is first seen, from 0; of a family that only the comparison with templates
    finds, of the paragraph's first line that holds a mark of one, with the share of the template as its probability. Families are those of
    NAMES and SENTENCES. A null or empty text has none; repeated rows stay; an input column named licenses is replaced, and one
    named __near goes.
    """
    model = trained()
    weights = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    bias = F.array(*[F.lit(float(v)) for v in model.bias])
    names = list(model.weights)
    whole = [(family, words) for family, own in sorted(NAMES.items()) for words in sorted({tuple(sorted(set(words_of(s)))) for s in own})]
    part = [(family, tuple(sorted(set(words_of(s))))) for family, own in sorted(SENTENCES.items()) for s in own]
    held = [(f, w, len(w)) for f, w in whole] + [(f, w, math.ceil(CONFIRM * len(w))) for f, w in part]
    grams = templates()
    known_grams = sorted({g for _, own in grams for g in own})
    hint, marks = one_of(model.anchors()), one_of(template_marks())
    either = one_of(sorted({*model.anchors(), *template_marks()}))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("licenses", "__near")]
    whole_text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    pieces = F.split(whole_text, _BLANK)
    starts = let(pieces, lambda p: F.arrays_zip(running(p, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1, lambda a, n: a + n).alias("start"), p.alias("run")))
    runs = F.filter(starts, lambda r: r["run"].rlike(either))
    empty = F.array().cast("array<struct<start:int,run:string>>")
    marked = docs.select(*kept, F.when(F.col(f"`{text}`").rlike(either), runs).otherwise(empty).alias("__near"))

    def tokens(line: Column) -> Column:
        return F.filter(F.split(F.lower(line), _WORDS), lambda w: w != "")

    def named(words: Column) -> Column:
        """(words, family, probability) of a line's words."""
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        known = F.filter(F.array_distinct(F.concat(words, pairs)), lambda f: f.isin(names))
        total = F.aggregate(known, bias, lambda a, f: F.zip_with(a, F.element_at(weights, f), lambda x, y: x + y))

        def best(z: Column) -> Column:
            top = F.array_max(z)
            spread = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - top) / model.temperature))
            family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position(z, top).cast("int"))
            return F.struct(words.alias("words"), family.alias("family"), (1 / spread).alias("probability"))

        return let(total, best)

    def of(line: Column) -> Column:
        return let(tokens(line), named)

    def accepted(s: Column) -> Column:
        return (s["family"] != "unknown") & (s["probability"] >= ACCEPT)

    def judged(p: Column) -> Column:
        """The line alone, or both lines where neither is accepted alone, or null."""

        def choose(alone: Column) -> Column:
            both = F.when((F.trim(p["next"]) != "") & ~accepted(of(p["next"])), of(F.concat_ws(" ", p["line"], p["next"])))
            return F.when(accepted(alone), alone).otherwise(both)

        return let(let(of(p["line"]), choose), lambda s: F.when(accepted(s), F.struct(p["paragraph"].alias("paragraph"), s["family"].alias("family"), s["probability"].alias("probability"), s["words"].alias("words"))))

    def confirmed(p: Column) -> Column:
        own = [F.when((p["family"] == family) & (F.size(F.array_intersect(p["words"], F.array(*map(F.lit, words)))) >= least), True) for family, words, least in held]
        return F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), F.coalesce(*own, F.lit(False)).alias("confirmed"))

    def by_lines(r: Column) -> Column:
        """What a paragraph's lines say."""

        def near(lines: Column) -> Column:
            each = F.transform(lines, lambda p, i: F.struct((r["start"] + i).cast("int").alias("paragraph"), p.alias("line"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next")))
            return F.filter(each, lambda p: p["line"].rlike(hint) | (p["next"].rlike(hint) & (F.trim(p["line"]) != "")))

        return F.transform(F.filter(F.transform(let(F.split(r["run"], "\n"), near), judged), lambda p: p.isNotNull()), confirmed)

    def by_templates(r: Column) -> Column:
        """(family, share) of the templates that a paragraph holds enough of."""

        def held_of(words: Column) -> Column:
            threes = F.zip_with(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
            return F.array_distinct(F.filter(threes, lambda g: g.isin(known_grams)))

        def shares(found: Column) -> Column:
            each = F.array(*[F.struct(F.lit(f).alias("family"), (F.size(F.array_intersect(found, F.array(*map(F.lit, own)))) / F.lit(float(len(own)))).alias("share")) for f, own in grams])
            none = F.array().cast("array<struct<family:string,share:double>>")
            return F.when(F.size(found) > 0, F.filter(each, lambda t: t["share"] >= CONFIRM)).otherwise(none)

        none = F.array().cast("array<struct<family:string,share:double>>")
        return F.when(r["run"].rlike(marks), let(let(tokens(r["run"]), held_of), shares)).otherwise(none)

    def merged(lines: Column, told: Column, r: Column) -> Column:
        """Each family once: where a line says it first, else where the template's words begin."""
        families = F.transform(lines, lambda p: p["family"])
        once = F.filter(lines, lambda p, i: F.array_position(families, p["family"]) == i + 1)
        sure = lambda f: F.exists(lines, lambda q: (q["family"] == f) & q["confirmed"]) | F.exists(told, lambda t: t["family"] == f)
        first = F.transform(once, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), sure(p["family"]).alias("confirmed")))
        others = F.filter(F.array_distinct(F.transform(told, lambda t: t["family"])), lambda f: ~F.array_contains(families, f))
        place = F.array_position(F.transform(F.split(r["run"], "\n"), lambda x: x.rlike(marks)), True) - 1
        best = lambda f: F.array_max(F.transform(F.filter(told, lambda t: t["family"] == f), lambda t: t["share"]))
        more = F.transform(others, lambda f: F.struct((r["start"] + place).cast("int").alias("paragraph"), f.alias("family"), best(f).alias("probability"), F.lit(True).alias("confirmed")))
        return F.concat(first, more)

    found = F.transform("__near", lambda r: let(by_lines(r), lambda lines: let(by_templates(r), lambda told: merged(lines, told, r))))
    return marked.withColumn("licenses", F.flatten(found)).drop("__near")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License paragraphs of every document: how many, how many confirmed, and their families."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses")
    listed = F.array_join(F.transform("licenses", lambda p: F.concat_ws(":", p["paragraph"].cast("string"), p["family"])), ",")
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_license"),
        F.size(F.filter("licenses", lambda p: p["confirmed"])).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("licenses", lambda p: p["confirmed"]), lambda p: p["family"]))), ",").alias("families"),
        listed.alias("paragraphs"),
        F.coalesce(F.round(F.array_max(F.transform("licenses", lambda p: p["probability"])), 6), F.lit(0.0)).alias("probability"),
    )


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
