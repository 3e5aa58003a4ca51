"""License scans by a positional index of rare license words.

An index holds, for each word of the license templates, its postings: the
templates it stands in and its places there.  Words are weighed by inverse
document frequency among the templates, so weights are fixed with the index.
The words of the highest weights, all but the ``COMMON`` ones with the most
postings, are looked up at all their places in a text.  A posting votes for
one position of its template relative to the text; votes are intersected by
(template, relative position).  Where the rarest word of a template's mandatory
key phrase has voted, the phrase is verified word for word, and the template
is found if words beyond the phrase hold at least ``SHARE`` of the weight that
the template's words beyond it have (a template that is its phrase needs none).

The base phrases are searched by word numbers of the same index, at every
place.

Defined results: null counts as empty; a text without words has no places,
null first and last word, empty labels and score 0; repeated rows are scanned
alike; labels and score follow from the text alone, whatever its length; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import ALNUM, Slab, doc_rows, lowered, map_slabs, runs, span_hash, table

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> (template, mandatory key phrase) pairs.
TEMPLATES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", "apache license version 2 0"),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
        (
            "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
            "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
            "permissions and limitations under the license",
            "apache org licenses license 2 0",
        ),
    ],
    "mit": [
        ("licensed under the mit license", "mit license"),
        ("released under the mit license", "mit license"),
        ("distributed under the mit license", "mit license"),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
            "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement",
            "the software is provided as is without warranty of any kind",
        ),
    ],
    "isc": [
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
            "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
            "permission to use copy modify and or distribute this software for any purpose",
        ),
    ],
    "gpl-3.0": [
        ("this work is licensed under the gnu general public license version 3", "general public license version 3"),
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
            "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
            "even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
            "either version 3 of the license or at your option any later version",
        ),
    ],
    "gpl-2.0": [
        ("this work is licensed under the gnu general public license version 2", "general public license version 2"),
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
            "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without "
            "even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
            "either version 2 of the license or at your option any later version",
        ),
    ],
    "lgpl": [("licensed under the gnu lesser general public license version", "lesser general public license")],
    "agpl-3.0": [("licensed under the gnu affero general public license version 3", "affero general public license")],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
            "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
            "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "redistributions of source code must retain the above copyright notice",
        ),
    ],
    "mpl-2.0": [
        ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
        (
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
            "http mozilla org mpl 2 0",
            "if a copy of the mpl was not distributed with this file",
        ),
    ],
    "cc-by-4.0": [("this work is licensed under cc by 4 0", "cc by 4 0"), ("creative commons attribution 4 0 international license", "creative commons attribution 4 0")],
    "cc-by-sa-4.0": [("this work is licensed under cc by sa 4 0", "cc by sa 4 0")],
    "cc-by-nc-4.0": [("this work is licensed under cc by nc 4 0", "cc by nc 4 0")],
    "cc0-1.0": [("to the extent possible under law the author has waived all copyright creative commons cc0 1 0 universal", "creative commons cc0")],
    "unlicense": [
        ("this is free and unencumbered software released into the public domain", "free and unencumbered software"),
        (
            "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or "
            "non commercial and by any means",
            "anyone is free to copy modify publish use compile sell or distribute this software",
        ),
    ],
}

#: Share of the weight beyond a key phrase that must stand where it stands in the template.
SHARE = 0.3
#: Words of the index with the most postings, which aren't looked up.
COMMON = 12


class Index:
    """Word numbers, postings and key phrases of license templates."""

    def __init__(self, templates: dict = TEMPLATES, common: int = COMMON):
        self.labels, self.words_of, self.keys, self.key_at = [], [], [], []
        number: dict[str, int] = {}
        for label, pairs in templates.items():
            for text, key in pairs:
                mine = [number.setdefault(w, len(number)) for w in text.split()]
                phrase = [number[w] for w in key.split()]
                self.labels.append(label)
                self.words_of.append(mine)
                self.keys.append(phrase)
                self.key_at.append(next(k for k in range(len(mine)) if mine[k : k + len(phrase)] == phrase))
        n_template = len(number)
        self.base = [([number.setdefault(w, len(number)) for w in p.split()], label) for p, label in BASE.items()]
        self.words = list(number)
        data = np.frombuffer("".join(self.words).encode(), np.uint8)
        size = np.array([len(w.encode()) for w in self.words])
        ends = np.cumsum(size)
        h = span_hash(data, ends - size, ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

        held = Counter(w for mine in self.words_of for w in set(mine))
        n = len(self.words_of)
        self.idf = np.array([np.log((n + 1) / (held[w] + 0.5)) if w < n_template else 0.0 for w in range(len(self.words))])
        # of each key phrase, the word that its lookups need
        self.lead = [max(range(len(key)), key=lambda k, key=key: (self.idf[key[k]], -k)) for key in self.keys]
        leads = {key[k] for key, k in zip(self.keys, self.lead, strict=True)}
        many = Counter(w for mine in self.words_of for w in mine)
        passed = {w for w, _ in sorted(many.items(), key=lambda x: (-x[1], x[0]))[:common]} - leads
        postings = sorted((w, t, p) for t, mine in enumerate(self.words_of) for p, w in enumerate(mine) if w not in passed)
        word, self.template, self.place = (np.array(x, np.int64) for x in zip(*postings, strict=True))
        self.posted = np.bincount(word, minlength=len(self.words))
        self.start = np.concatenate([[0], np.cumsum(self.posted)])
        key_at, key_size = np.array(self.key_at), np.array([len(k) for k in self.keys])
        self.beyond = (self.place < key_at[self.template]) | (self.place >= (key_at + key_size)[self.template])
        self.leads = self.place == (key_at + np.array(self.lead))[self.template]
        self.weight = self.idf[word]
        self.total = np.bincount(self.template, self.weight, n)
        self.total_beyond = np.bincount(self.template, self.weight * self.beyond, n)
        self.is_lead = np.isin(np.arange(len(self.words)), list(leads))
        self.longest = max(map(len, self.words_of))

    def numbers(self, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
        """The word number at each word of the slab (-1: none) and borders."""
        data = lowered(slab.data)
        starts, ends, first = runs(ALNUM[data], slab.offs)
        h = span_hash(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1), first

    def found(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, template, share of weight) of each template at each relative position that holds it."""
        hit = np.flatnonzero(words >= 0)
        text = np.searchsorted(first, hit, side="right") - 1
        # a text without the lead of any phrase has no template
        asked = np.zeros(len(first), bool)
        asked[text[self.is_lead[words[hit]]]] = True
        hit, text = hit[asked[text]], text[asked[text]]
        n = self.posted[words[hit]]
        if not n.sum():
            return []
        of = np.repeat(np.arange(len(hit)), n)
        posting = self.start[words[hit]][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        position = hit[of] - self.place[posting]  # where the template would begin
        width = len(words) + self.longest
        key = (text[of] * width + position + self.longest) * len(self.labels) + self.template[posting]
        groups, member = np.unique(key, return_inverse=True)
        votes = np.bincount(member, self.weight[posting])
        beyond = np.bincount(member, self.weight[posting] * self.beyond[posting])
        led = np.bincount(member, self.leads[posting]) > 0
        template = groups % len(self.labels)
        need = self.total_beyond[template]
        good = np.flatnonzero(led & ((need == 0) | (beyond >= SHARE * need)))
        out = []
        for t, rest, weight in zip(template[good].tolist(), (groups[good] // len(self.labels)).tolist(), votes[good].tolist(), strict=True):
            phrase = self.keys[t]
            doc, begin = rest // width, rest % width - self.longest + self.key_at[t]
            if first[doc] <= begin and begin + len(phrase) <= first[doc + 1] and words[begin : begin + len(phrase)].tolist() == phrase:
                out.append((doc, t, round(min(1.0, weight / float(self.total[t])), 9)))
        return out


def _places(words: np.ndarray, phrase: list[int]) -> np.ndarray:
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = words[:n] == phrase[0]
    for k in range(1, len(phrase)):
        ok &= words[k : k + n] == phrase[k]
    return np.flatnonzero(ok)


def scanned(docs: DataFrame, templates: dict = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of the base phrases and all labels of each row."""
    index = Index(templates)

    def run(slab: Slab) -> dict:
        words, first = index.numbers(slab)
        more, score = [set() for _ in range(len(slab))], [0.0] * len(slab)
        for i, t, share in index.found(words, first):
            more[i].add(index.labels[t])
            score[i] = max(score[i], share)
        out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for i in range(len(slab)):
            w = words[first[i] : first[i + 1]]
            places, labels = [], set()
            if len(w) and w.max() >= 0:
                for phrase, label in index.base:
                    if len(at := _places(w, phrase)):
                        places.append(at)
                        labels.add(label)
            every = np.concatenate(places) if places else np.zeros(0, np.int64)
            out["n_words"].append(len(w))
            out["n_base"].append(len(every))
            out["first_word"].append(int(every.min()) if len(every) else None)
            out["last_word"].append(int(every.max()) if len(every) else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | more[i])))
            out["score"].append(max(score[i], 0.5 if labels else 0.0))
        return out | {"doc_id": slab.ids}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
