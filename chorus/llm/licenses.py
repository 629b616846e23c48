"""Operator 7, licence scans: sparse TF-IDF cosine to licence templates, then inheritance by directory.

Every line of every file, and the whole text of files named like licence files, is a passage. Passages
are vectors of term frequency times inverse document frequency over the templates' words; words that no
template has enter the length of the vector with the largest weight. Document frequencies count all
passages of all files. A passage whose best cosine reaches ``LEAST`` carries that template's licence;
a file's own licence is that of its best passage.

Templates are short notices, the usual headers of several lines and whole licence texts. Since notices wrap and
stand among other words, every text is also read in windows: for each template of n words, runs of n words (fewer
at the end of the text) across line breaks, without comment marks, beginning at every ``n // STEPS`` words. A window counts
only where its cosine with its template reaches ``LEAST``. Among the passages and windows that reach it, a template of
twice the words goes before a cosine that is higher by less than ``DOUBLE``, so a whole licence text goes before the
sentence it shares with another licence.

A directory's licence is that of its licence file (the best scored, then the first by name). A file
without a licence of its own takes that of the nearest directory above it, found by joining the
ancestors of each distinct directory with the licensed directories.

Defined results: null and empty texts have no passage; a null path lies in no directory; files at the root
inherit from the root; ties go to the first template; equal files are scored alike and repeated rows
stay repeated; an empty table gives an empty result; very long texts are read whole; other columns travel along, and a
new column (``own_license``, ``own_score``, ``license``, ``inherited_from``) whose name the files have already gets trailing underscores.

Scale: two passes over the texts (frequencies, scores), both without moving text; windows cost a few running sums per
template, and counts only where those sums allow a cosine of ``LEAST``; lines meet the templates in slices; what is shuffled are
per-task sums over the fixed vocabulary, distinct directories and one narrow row per file. Hot directories
are one row on the joined side.
"""

from __future__ import annotations

import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.shared import stored
from chorus.llm.textarrays import ALNUM, Words, chunks_of, fresh, map_texts, quoted

LEAST = 0.75
STEPS = 16                          # windows begin at so many places per length of their template
DOUBLE = 0.02
PAIRS = 1 << 15                     # distinct words of lines that meet all templates at a time
SLICE = 1 << 18                     # words of windows that are counted at a time

_GNU = ("{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the "
        "Free Software Foundation; either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU {1} General Public License for more details.")
_TITLE = "GNU {0} GENERAL PUBLIC LICENSE Version {1} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _full(name: str) -> str:
    return pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")


# Usual short notices and headers of well-known licences, then whole licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    *[(name, _GNU.format(work, kind, version)) for work in ("This program", "This library")
      for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))],
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", _TITLE.format("", "2, June 1991")),
    ("GPL-3.0", _TITLE.format("", "3, 29 June 2007")),
    ("LGPL-2.1", _TITLE.format("LESSER", "2.1, February 1999")),
    ("LGPL-3.0", _TITLE.format("LESSER", "3, 29 June 2007")),
    ("AGPL-3.0", _TITLE.format("AFFERO", "3, 19 November 2007")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *[(name, _full(name)) for name in ("0BSD", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")],
]
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    return Words(raw, np.array([0, len(raw)]), ALNUM).hashes


def vocabulary(templates: list[tuple[str, str]] = TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([_words(t) for _, t in templates]))


def passages(buf: np.ndarray, offs: np.ndarray, whole: np.ndarray, terms: np.ndarray):
    """(words, term of each word or -1, passage of each word, text of each passage, words counted twice).

    Passages are the lines; a licence file's words also form one passage of the whole text."""
    words = Words(buf, offs, ALNUM)
    spot = np.searchsorted(terms, words.hashes)
    spot[spot == len(terms)] = 0
    term = np.where(terms[spot] == words.hashes, spot, -1)
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))
    text = words.text_of_word()
    line = breaks[words.starts] + text
    extra = whole[text] if len(text) else np.zeros(0, bool)
    term = np.concatenate((term, term[extra]))
    key = np.concatenate((2 * line, 2 * text[extra] + 1))
    text = np.concatenate((text, text[extra]))
    _, first, unit = np.unique(key, return_index=True, return_inverse=True)
    return term, unit, text[first]


def window_hits(term: np.ndarray, first: np.ndarray, weight: np.ndarray, rare: float, matrix: np.ndarray, lengths: list[int], least: float):
    """(text, template, cosine) of the windows that reach ``least``; ``term`` has the term of each word or -1,
    text t has the words ``first[t]`` to ``first[t + 1]``.

    The products of all windows with a template are differences of one running sum. Counted one by one, words
    give a vector no longer than its true one, so the same sums bound the cosine from above and only windows
    that may reach ``least`` are counted."""
    size, found = len(weight), []
    held = np.where(term >= 0, term, 0)
    unknown = np.concatenate(([0], np.cumsum(term < 0)))
    square = np.concatenate(([0.0], np.cumsum(np.where(term >= 0, weight[held] ** 2, rare**2))))
    grids = {}
    for k, n in enumerate(lengths):
        if n not in grids:
            step = max(1, n // STEPS)
            per = -(-np.diff(first) // step)
            text = np.repeat(np.arange(len(per)), per)
            start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * step
            end = np.minimum(start + n, first[text + 1])
            grids[n] = text, start, end, np.sqrt(square[end] - square[start]) + 1e-12
        text, start, end, length = grids[n]
        run = np.concatenate(([0.0], np.cumsum(np.where(term >= 0, (weight * matrix[:, k])[held], 0.0))))
        product = run[end] - run[start]
        maybe = np.flatnonzero(product >= (least - 1e-6) * length)
        some = max(1, SLICE // n)
        for at in range(0, len(maybe), some):
            pick = maybe[at : at + some]
            sizes = end[pick] - start[pick]
            owner = np.repeat(np.arange(len(pick)), sizes)
            word = term[np.repeat(start[pick] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            pair, count = np.unique(owner[word >= 0] * size + word[word >= 0], return_counts=True)
            exact = np.bincount(pair // size, (count * weight[pair % size]) ** 2, len(pick)) + (unknown[end[pick]] - unknown[start[pick]]) * rare**2
            cosine = product[pick] / np.sqrt(exact)
            hit = cosine >= least
            found.append((text[pick[hit]], np.full(hit.sum(), k), cosine[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def best_templates(term: np.ndarray, unit: np.ndarray, n: int, weight: np.ndarray, rare: float, matrix: np.ndarray, worth: np.ndarray, least: float):
    """(template, cosine) of the best template of each of ``n`` passages; ``term`` has the term of each word or -1, ``unit`` its passage.

    Passages are compared in slices of about ``PAIRS`` distinct words or passages, so a long text of short lines needs no
    row of all templates for each of its lines at once."""
    size, known = len(weight), term >= 0
    pair, count = np.unique(unit[known] * size + term[known], return_counts=True)
    of, t = pair // size, pair % size
    value = count * weight[t]
    square = np.bincount(of, value**2, n) + np.bincount(unit[~known], minlength=n) * rare**2
    top, high = np.zeros(n, int), np.zeros(n)
    cuts = np.unique(np.concatenate((of[::PAIRS], np.arange(0, n, PAIRS), [n])))
    places = np.searchsorted(of, cuts)
    for a, b, lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
        cosine = np.zeros((b - a, matrix.shape[1]))
        head = np.flatnonzero(np.diff(of[lo:hi], prepend=-1))
        if hi > lo:
            cosine[of[lo:hi][head] - a] = np.add.reduceat(value[lo:hi, None] * matrix[t[lo:hi]], head, axis=0)
        cosine /= np.sqrt(np.maximum(square[a:b], 1e-30))[:, None]
        top[a:b] = np.where(cosine >= least, cosine + worth, cosine - 1).round(9).argmax(1)
        high[a:b] = cosine[np.arange(b - a), top[a:b]]
    return top, high


def frequencies(files: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """(passages, passages with each term) over all texts; tasks send one row per term."""
    size = len(terms)
    given = files.select("whole", "text")

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            flags = np.array(batch.column("whole").to_pylist(), bool)
            for lo, hi, buf, offs in chunks_of(batch.column("text")):
                term, unit, owner = passages(buf, offs, flags[lo:hi], terms)
                total[size] += len(owner)
                known = term >= 0
                total[:size] += np.bincount(np.unique(unit[known] * size + term[known]) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["term", "n"])

    sums = given.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for r in sums:
        out[r.term] = r.n
    return int(out[size]), out[:size]


def own_names(files: DataFrame) -> tuple[str, str]:
    """Names of the columns that ``scored`` adds to ``files``."""
    return fresh(files, "own_license"), fresh(files, "own_score")


def scored(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files`` (with path, text and any more) without the text, plus ``own_license`` and ``own_score`` (see ``own_names``)."""
    terms = vocabulary(templates)
    flag, (licence, score) = fresh(files, "whole"), own_names(files)
    named = files.withColumn(flag, F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)))
    total, held = frequencies(named.select(F.col(flag).alias("whole"), F.col("text").cast("string").alias("text")), terms)
    weight = np.log((1 + total) / (1 + held)) + 1
    rare = float(np.log(1 + total) + 1)
    ids = [np.searchsorted(terms, _words(t)) for _, t in templates]
    matrix = np.stack([np.bincount(i, minlength=len(terms)) * weight for i in ids], 1)
    matrix = matrix / np.linalg.norm(matrix, axis=0)
    lengths = [len(i) for i in ids]
    worth = DOUBLE * np.log2(lengths)
    marks = np.unique(_words("dnl rem"))
    names = [n for n, _ in templates]
    keep = [c for c in named.columns if c not in ("text", flag)]
    # the flag travels as the first byte of the text, so that a chunk has both
    joined = named.withColumn("text", F.concat(F.when(F.col(flag), "1").otherwise("0"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    fields = [T.StructField(licence, T.StringType()), T.StructField(score, T.DoubleType())]

    def work(buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        n = len(offs) - 1
        whole = buf[offs[:-1]] == ord("1")
        body = buf.copy()
        body[offs[:-1]] = 32
        term, unit, owner = passages(body, offs, whole, terms)
        best, place = np.zeros(n), np.full(n, -1)
        if len(term):
            top, high = best_templates(term, unit, len(owner), weight, rare, matrix, worth, least)
            words = Words(body, offs, ALNUM)
            line = np.concatenate(([0], np.cumsum(body == 10)))[words.starts] + words.text_of_word()
            code = ~(np.isin(words.hashes, marks) & (np.diff(line, prepend=-1) > 0))
            first = np.concatenate(([0], np.cumsum(code)))[words.first]
            w_text, w_top, w_high = window_hits(term[: len(code)][code], first, weight, rare, matrix, lengths, least)
            owner, top, high = np.concatenate((owner, w_text)), np.concatenate((top, w_top)), np.round(np.concatenate((high, w_high)), 9)
            rank = np.where(high >= least, high + worth[top], high - 1).round(9)
            order = np.lexsort((top, -rank, owner))
            head = order[np.unique(owner[order], return_index=True)[1]]
            best[owner[head]], place[owner[head]] = high[head], top[head]
        hit = best >= least
        return [pa.array([names[p] if h else None for p, h in zip(place.tolist(), hit.tolist(), strict=True)], pa.string()), pa.array(best)]

    return map_texts(joined, "text", fields, work, keep)


def folder_of(path: Column) -> Column:
    """Directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(files: DataFrame, licence: str = "own_license", score: str = "own_score") -> DataFrame:
    """``files`` (path, the columns ``licence`` and ``score`` of ``scored``, and more) plus ``license`` and ``inherited_from``."""
    place, from_folder, from_license = (fresh(files, c) for c in ("in_folder", "from_folder", "from_license"))
    out, source = fresh(files, "license"), fresh(files, "inherited_from")
    own, given = F.col(quoted(licence)), [F.col(quoted(c)) for c in files.columns]
    held = files.withColumn(place, folder_of(F.col("path")))
    carriers = held.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & own.isNotNull())
    carriers = carriers.select(F.col(place).alias("above"), F.col(quoted(score)).alias("score"), "path", own.alias("held"))
    licensed = carriers.groupBy("above").agg(F.min(F.struct(-F.col("score"), "path", "held"))["held"].alias("above_license"))
    folders = held.select(F.col(place).alias("folder")).where("folder is not null").distinct()
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    nearest = (folders.withColumn("above", F.explode(above)).join(licensed, "above")
               .groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "above_license")).alias("best"))
               .select(F.col("folder").alias(place), F.col("best.above").alias(from_folder), F.col("best.above_license").alias(from_license)))
    return held.join(nearest, place, "left").select(*given, F.coalesce(own, F.col(from_license)).alias(out), F.when(own.isNull(), F.col(from_folder)).alias(source))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of source trees: ``<doc_id / 100>/<doc_id / 10>/<doc_id>.txt``; the first document of each
    ten stands for a LICENSE file, as the tables have no paths of their own."""
    ten, hundred = F.floor(F.col("doc_id") / 10), F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", hundred.cast("string"), ten.cast("string"), name).alias("path"), "text")


def scan(files: DataFrame) -> DataFrame:
    """Own and inherited licence of every file."""
    return inherited(stored(scored(files), "licences"), *own_names(files))
