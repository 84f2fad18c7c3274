"""License scans by conditional compression.

Each license cue in a text's stream of words opens windows, one for each place that a cue has in a template: they reach back as many
words as the template has before it, over line ends. Every window that holds enough of its template's words is confirmed
by exact wording: the words the template has and the block lacks, or the block has inside the match, must be few, and none of the
template's deciding words (name, version, variant) may differ. Of confirmed blocks that overlap the closest counts, then the one of which
the template, as zstandard's raw dictionary, saves the larger share; all others are found. A cue outside of them is reported beside
the template that saves most.

Edge cases: null and empty texts have no candidates; a cue without a confirmed template is reported as unconfirmed;
very long texts are scanned whole; repeated rows are scanned one by one; an empty table gives an empty result. Of blocks that are as
close and save as much the earlier template counts, then the earlier place; columns but doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specmatch.llm.textvec import pieces

#: Lower-case strings of which every license notice has one (fixed values).
CUES = ("licens", "licenc", "copyright", "cc by", "cc0", "spdx", "permission is hereby", "public domain", "redistribut", "warrant")

#: Public license notices: name, deciding words, wording (fixed values).
TEMPLATES = (
    ("MIT", ("mit",), "Released under the MIT License."),
    ("MIT", ("mit",), "Licensed under the MIT license."),
    ("MIT", (), 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", ("apache", "2", "0"), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", ("apache", "2", "0"), 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", ("gnu", "general", "3"), "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", ("gnu", "general", "3", "later"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", ("gnu", "general", "2"), "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", ("gnu", "lesser", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", ("gnu", "affero", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", ("3", "bsd"), "Licensed under the BSD 3-Clause License."),
    ("BSD", (), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", ("mozilla", "2", "0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", ("fee",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", ("cc", "by", "4", "0"), "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", ("cc", "by", "sa", "4", "0"), "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", ("cc", "by", "nc", "4", "0"), "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", ("cc", "by", "nc", "sa", "4", "0"), "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", ("cc", "by", "nd", "4", "0"), "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", ("cc0",), "Released under CC0 1.0 Universal."),
    ("Unlicense", ("unencumbered",), "This is free and unencumbered software released into the public domain."),
    ("proprietary", ("reserved",), "Copyright. All rights reserved."),
)
_WORD = re.compile(r"\w+")
#: A cue may run over a line end or a comment mark.
_CUE = "|".join(c.replace(" ", r"\W+") for c in CUES)
_CUES = re.compile(_CUE)


def split_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Found:
    line: int
    license: str | None
    reduction: float
    missing: int
    added: int
    block: str


class Scanner:
    def __init__(self, templates=TEMPLATES, level: int = 12, slack: float = 0.2):
        import zstandard

        self.templates = [(name, set(deciding), split_words(text)) for name, deciding, text in templates]
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=level, **options)
        self.primed = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, _, words in self.templates]
        self.counts = [Counter(words) for _, _, words in self.templates]
        self.limits = [max(1, round(slack * len(words))) for _, _, words in self.templates]
        self.offsets = [_cue_words(" ".join(words))[1] or [0] for _, _, words in self.templates]

    def reduction(self, block: bytes, k: int) -> float:
        """Share of the block's compressed size that template k as dictionary saves."""
        alone = len(self.plain.compress(block))
        return 1 - len(self.primed[k].compress(block)) / alone

    def differences(self, words: list[str], k: int) -> tuple[int, int]:
        """Words of template k that the block lacks, and words the block has inside the match."""
        wanted = self.templates[k][2]
        blocks = [b for b in difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            return len(wanted), 0
        equal = sum(b.size for b in blocks)
        return len(wanted) - equal, blocks[-1].b + blocks[-1].size - blocks[0].b - equal

    def confirm(self, words: list[str], k: int) -> tuple[int, int, int, int] | None:
        """Both differences and the span of the closest run of matches; None if they are too many or a deciding word is off."""
        _, deciding, wanted = self.templates[k]
        match = difflib.SequenceMatcher(None, wanted, words, autojunk=False)
        blocks, found = [b for b in match.get_matching_blocks() if b.size], None
        for i in range(len(blocks)):
            equal = 0
            for b in blocks[i:]:
                equal += b.size
                low, high = blocks[i].b, b.b + b.size
                missing, added = len(wanted) - equal, high - low - equal
                if missing + added <= self.limits[k] and (found is None or missing + added < found[0] + found[1]) and deciding <= set(words[low:high]):
                    found = (missing, added, low, high)
        return found

    def confirmed(self, words: list[str], cues: list[int]) -> dict[tuple[int, int, int], tuple[int, int]]:
        """(template, start, end) of every confirmed block, and its differences."""
        sure, tried = {}, set()
        for at in cues:
            for k, (_, deciding, wanted) in enumerate(self.templates):
                limit = self.limits[k]
                for offset in self.offsets[k]:
                    first, last = max(0, at - offset - limit), max(0, at - offset + len(wanted) + limit)
                    if (k, first, last) in tried:
                        continue
                    tried.add((k, first, last))
                    own = words[first:last]
                    if not deciding <= set(own):
                        continue
                    has = Counter(own)
                    if sum(min(n, has[w]) for w, n in self.counts[k].items()) < len(wanted) - limit:  # no order of these words confirms
                        continue
                    if got := self.confirm(own, k):
                        missing, added, a, b = got
                        sure[k, first + a, first + b] = (missing, added)
        return sure

    def scan(self, text: str) -> list[Found]:
        low = text.lower()
        words, cues, starts = _cue_words(low)
        ends = [m.start() for m in re.finditer("\n", low)]
        line = lambda at: bisect_right(ends, starts[at])
        sure = self.confirmed(words, cues)
        ranked = sorted((missing + added, -self.reduction(" ".join(words[a:b]).encode(), k), k, a, b, missing, added) for (k, a, b), (missing, added) in sure.items())
        out, taken, covered = [], [], set()
        for _, saved, k, a, b, missing, added in ranked:
            if not any(a < d and c < b for _, c, d in taken):
                taken.append((self.templates[k][0], a, b))
                covered |= set(range(a, b))
                out.append((a, Found(line(a), self.templates[k][0], -saved, missing, added, " ".join(words[a:b]))))
        for k, a, b in sure:  # the rest of a notice whose shorter wording was closer
            if any(name == self.templates[k][0] and a < d and c < b for name, c, d in taken):
                covered |= set(range(a, b))
        until, where = 0, -1
        for at in cues:
            if at in covered or (at < until and line(at) == where):
                continue
            saved, k, a, b = self._closest(words, at)
            missing, added = self.differences(words[a:b], k)
            out.append((at, Found(line(at), None, saved, missing, added, " ".join(words[a:b]))))
            until, where = b, line(at)
        return [f for _, f in sorted(out, key=lambda x: x[0])]

    def _closest(self, words: list[str], at: int) -> tuple[float, int, int, int]:
        """The template that saves most of its window about the cue at ``at``: share, template, window."""
        found = []
        for k, (_, _, wanted) in enumerate(self.templates):
            a, b = max(0, at - self.offsets[k][0]), max(at + 1, at - self.offsets[k][0] + len(wanted))
            found.append((self.reduction(" ".join(words[a:b]).encode(), k), -k, a, b))
        saved, k, a, b = max(found)
        return saved, -k, a, b


def _cue_words(low: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a lower-case text, the places among them that cues start at, and where each word starts."""
    found = [(m.group(), m.start()) for m in _WORD.finditer(low)]
    starts = [at for _, at in found]
    return [w for w, _ in found], sorted({bisect_right(starts, m.start()) - 1 for m in _CUES.finditer(low)}), starts


def has_cue(text: Column) -> Column:
    """A JVM-side test that spares the other texts the way to Python."""
    return F.coalesce(F.lower(text).rlike(_CUE), F.lit(False))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_candidates, n_confirmed, licenses (distinct confirmed names, sorted, joined by a blank) and findings (JSON) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in pieces(batches, "text"):
            found = [scanner.scan(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([sum(x.license is not None for x in f) for f in found], pa.int64()),
                    pa.array([" ".join(sorted({x.license for x in f if x.license})) for f in found]),
                    pa.array([json.dumps([{"line": x.line, "license": x.license, "reduction": round(x.reduction, 4), "missing": x.missing, "added": x.added, "block": x.block} for x in f], ensure_ascii=False) for f in found]),
                ],
                names=["doc_id", "n_candidates", "n_confirmed", "licenses", "findings"],
            )

    return docs.select("doc_id", F.when(has_cue(F.col("text")), F.col("text")).alias("text")).mapInArrow(run, "doc_id long, n_candidates long, n_confirmed long, licenses string, findings string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
