"""License scans by conditional compression.

The words around a cue word, over lines and sentences, form candidate blocks: for each template the runs of its
length over the cue, an eighth of it apart, and those of twice its length, its length apart. A block is compressed by
itself and with the template as zstandard raw dictionary, both as lower-case words, so that neither case nor
wrapping counts. Templates rank by the bytes saved at their best block, as a share of what they save on their own
wording. All that save a share of ``SAVING``, however many, are confirmed by the exact wording differences at the
best place that holds the cue: at least ``MATCH`` of the template's words must appear in order, and none of its
names or version numbers may be missing or replaced. Of those confirmed the one with the fewest differences is
the notice.

Cases: null and empty texts have no block; a text may hold several licenses, listed once each in order of
place; ties go to the template named first; rows are judged one by one, so repeated rows agree; extra
columns are ignored; an empty table gives no rows. Texts are scanned whole.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, table

# The wording of common license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Released under the BSD License.",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUES = re.compile(r"licen[sc]|copyright|public[\W_]+domain|permission[\W_]+(?:is[\W_]+hereby|to[\W_]+use)|redistribut", re.I)

#: Share of a template's words that must match; share of its own saving that a template needs at a block.
MATCH, SAVING = 0.8, 0.3
#: Compressed sizes that are kept for blocks that come again.
KNOWN = 1 << 13
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_PLAIN = frozenset("a an and any by for in is it of or that the this to under with work licensed released license version".split())


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Words of a block on each side of its cue: those of the longest template, and a quarter more for words put in.
AROUND = max(len(_words(t)) for t in TEMPLATES.values()) * 5 // 4


def cues(text: str) -> tuple[list[re.Match], list[int]]:
    """The words of a text and which of them begin or hold a cue; no words without a cue."""
    at = [m.start() for m in CUES.finditer(text)]
    words = list(_WORD.finditer(text)) if at else []
    starts = [m.start() for m in words]
    return words, sorted({bisect.bisect_right(starts, x) - 1 for x in at})


def blocks(text: str) -> list[tuple[int, str]]:
    """(place, block): the words around cues, over lines and sentences; blocks that overlap are one."""
    words, at = cues(text)
    out: list[list[int]] = []
    for c in at:
        if out and c - AROUND <= out[-1][1]:
            out[-1][1] = min(c + AROUND, len(words) - 1)
        else:
            out.append([max(0, c - AROUND), min(c + AROUND, len(words) - 1)])
    return [(words[i].start(), text[words[i].start() : words[j].end()]) for i, j in out]


def aligned(a: list[str], b: list[str]) -> tuple[int, int, int, list[str], list[str]]:
    """(first, end, words matched in order, words of ``b`` missing, words put in their place) at the best place in ``a``.

    Of the runs of equal words those neighbours count that match more words than they put between.
    """
    runs = [m for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return 0, 0, 0, b, []
    best, total, at = (0, 0, 0), 0, 0
    for i, m in enumerate(runs):
        total -= m.a - runs[i - 1].a - runs[i - 1].size if i else 0
        if total <= 0:
            total, at = 0, i
        total += m.size
        best = max(best, (total, at, i + 1), key=lambda x: x[0])
    runs = runs[best[1] : best[2]]
    found = {j for m in runs for j in range(m.b, m.b + m.size)}
    inside = {i for m in runs for i in range(m.a, m.a + m.size)}
    first, end = runs[0].a, runs[-1].a + runs[-1].size
    return first, end, len(found), [w for j, w in enumerate(b) if j not in found], [a[i] for i in range(first, end) if i not in inside]


def differences(block: str, template: str) -> tuple[int, list[str], list[str]]:
    """(words matched in order, template words that are missing, words put in their place) at the template's best place."""
    return aligned(_words(block), _words(template))[2:]


class LicenseScanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(19, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.templates = templates
        self.words = {name: _words(t) for name, t in templates.items()}
        self.names = {name: set(w) - _PLAIN for name, w in self.words.items()}
        self.order = {name: i for i, name in enumerate(templates)}
        self.longest = 1 + max(len(x) for w in self.words.values() for x in w)
        self.plain = z.ZstdCompressor(compression_params=params)
        self.given = {name: z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(self._bytes(w), dict_type=z.DICT_TYPE_RAWCONTENT)) for name, w in self.words.items()}
        self.size = functools.lru_cache(KNOWN)(lambda data, name: len((self.plain if name is None else self.given[name]).compress(data)))
        self.own = {name: max(1, self._saved(w, name)) for name, w in self.words.items()}

    def _bytes(self, words: list[str]) -> bytes:
        """The words as they are compressed; words longer than any template's, which match none, by their beginning."""
        return " ".join(w[: self.longest] for w in words).encode()

    def _saved(self, words: list[str], name: str) -> int:
        data = self._bytes(words)
        return self.size(data, None) - self.size(data, name)

    def saving(self, words: list[str], name: str) -> float:
        """The share of bytes that the template saves."""
        return self._saved(words, name) / self.size(self._bytes(words), None)

    def ranked(self, words: list[str], cue: int) -> list[tuple[float, str]]:
        """(share of its own saving, template) of all that save ``SAVING`` at a block over the word ``cue``, best first."""
        out = []
        for name, template in self.words.items():
            n = len(template)
            # they begin at multiples of their step, so that neighbouring cues share them
            places = [(low, low + size) for size, step in ((n, max(1, n // 8)), (2 * n, n)) for low in range(-((size - 1 - cue) // step) * step, cue + 1, step)]
            share = max(self._saved(words[max(0, low) : high], name) for low, high in places) / self.own[name]
            if share >= SAVING:
                out.append((share, name))
        return sorted(out, key=lambda x: -x[0])

    def _confirmed(self, words: list[str], cue: int, name: str) -> tuple[int, int, list[str], list[str]] | None:
        """(first, end, missing, put) where the template stands over the word ``cue``."""
        template, low, high = self.words[name], max(0, cue - AROUND), min(len(words), cue + AROUND + 1)
        while self.names[name] <= set(words[low:high]):
            first, end, n, missing, put = aligned(words[low:high], template)
            first, end = first + low, end + low
            if not n or first <= cue < end:
                good = n >= MATCH * len(template) and all(w in _PLAIN for w in missing) and not any(c.isdigit() for w in put for c in w)
                return (first, end, missing, put) if good else None
            low, high = (end, high) if end <= cue else (low, first)  # the best place is another notice's
        return None

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, saving, words missing, words put in) of each confirmed notice."""
        out = []
        places, at = cues(text)
        words, exact = [m[0].lower() for m in places], 0
        for cue in at:
            if cue < exact:  # a word of a notice that is found without a difference
                continue
            best = None
            for _, name in self.ranked(words, cue):
                if (d := self._confirmed(words, cue, name)) is not None:
                    first, end, missing, put = d
                    saving = self.saving(words[first:end], name)
                    rank = (len(missing) + len(put), -len(self.templates[name]), -saving, self.order[name])
                    if best is None or rank < best[0]:
                        best = (rank, (name, saving, len(missing), len(put)), end)
            if best is not None:
                exact = exact if best[0][0] else best[2]
                if best[1][0] not in {x[0] for x in out}:
                    out.append(best[1])
        return out


SCHEMA = "doc_id long, n_blocks long, license string, saving double, words_missing long, words_added long, licenses string"


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: candidate blocks, the license that saves most with its differences, and all licenses found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner()
        for batch in batches:
            for rows, texts in byte_chunks(batch, "text"):
                out = []
                for doc, text in zip(rows.column(0).to_pylist(), texts.to_pylist(), strict=True):
                    found = scanner.scan(text)
                    best = max(found, key=lambda x: x[1], default=(None, None, None, None))
                    out.append((doc, len(blocks(text)), *best, ",".join(x[0] for x in found)))
                types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
