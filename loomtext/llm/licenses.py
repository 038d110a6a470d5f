"""License scan by diagonal voting (operator 2).

The hash of every run of three words of every text is joined with the runs of the license
templates. Runs that match on one diagonal (place in the text less place in the template)
vote together; neighbouring diagonals, as an inserted or dropped word leaves them, are
merged to spans; a span that covers enough of its template is verified word by word. The
words that tell one license from another must be the same; of templates that cover one
span the best is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import kernels as K
from loomtext.llm.shared import BROADCAST_BYTES, content_key, join_checked, materialise, table

GRAM = 3
#: Diagonals this many words apart at most, whose runs are this near, are of one span.
NEAR_DIAGONALS = 3
GAP = 12
#: A candidate's votes come to this share of its template's runs at least; a verified span's equal words to this share of the words.
LEAST_VOTES = 0.5
LEAST_EQUAL = 0.8
#: Words that tell licenses apart: in a verified span all of them match, in the text and in the template. Numbers of up to two digits do so in templates of up to SHORT words.
MARKS = frozenset(b"lesser affero sa nc nd sharealike noncommercial noderivatives noderivs neither advertising".split())
SHORT = 80

TEMPLATES: dict[str, str] = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "BSD-line": "Released under the BSD License.",
    "ISC-line": "Released under the ISC License.",
    "zlib-line": "Released under the zlib License.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
#: Whole texts, by file name.
TEMPLATES |= {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words_of(text: str) -> list[bytes]:
    buf, starts, ends, _ = K.words(pa.array([text], pa.string()))
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def marks(words: list[bytes], numbers: bool) -> set[int]:
    """Places of the words that tell licenses apart."""
    return {i for i, w in enumerate(words) if w in MARKS or numbers and w.isdigit() and len(w) <= 2}


def best_spans(found: list[tuple]) -> list[tuple]:
    """Of spans (doc_id, license, first, last, votes, share, equal, all words) that lie on each other by half of the shorter one, that of the most equal words less the unequal ones."""
    kept: list[tuple] = []
    for r in sorted(found, key=lambda r: (r[7] - 2 * r[6], -r[5], r[1], r[2])):
        if all(2 * (min(r[3], k[3]) - max(r[2], k[2]) + 1) < min(r[3] - r[2], k[3] - k[2]) + 1 for k in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: (r[2], r[1]))


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, starts, ends, counts = K.words(texts)
    return K.kgrams(K.span_hashes(buf, starts, ends), counts, GRAM)


def template_runs(templates: dict[str, str]) -> list[tuple[int, str, int, int]]:
    """(run, license, place, runs in the template); a run that a template repeats would vote on wrong diagonals, and is left out."""
    names = list(templates)
    h, owner, place = _runs(pa.array(list(templates.values()), pa.string()))
    _, back, count = np.unique(np.stack([h, owner.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    once = count[back.ravel()] == 1
    h, owner, place = h[once], owner[once], place[once]
    total = np.bincount(owner, minlength=len(names))
    return [(int(x), names[o], int(p), int(total[o])) for x, o, p in zip(h.view(np.int64), owner, place)]


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in K.slices(batch.column(2)):
            part = batch.slice(i, j - i)
            h, owner, place = _runs(part.column(2))
            at = pa.array(owner)
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(place, pa.int32()), pa.array(h.view(np.int64))], ["doc_id", "content", "place", "run"])


def _verifier(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: words_of(text) for name, text in templates.items()}
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                words, found = words_of(text.as_py()), []
                for span in spans.as_py():
                    template = known[span["license"]]
                    # As far around the span as the template goes beyond its matched runs.
                    low = max(0, span["first"] - span["t_first"])
                    high = min(len(words), span["last"] + GRAM + len(template) - GRAM - span["t_last"])
                    blocks = [b for b in SequenceMatcher(None, words[low:high], template, autojunk=False).get_matching_blocks() if b.size]
                    equal = sum(b.size for b in blocks)
                    if not blocks:
                        continue
                    first, last = low + blocks[0].a, low + blocks[-1].a + blocks[-1].size - 1
                    share = equal / max(len(template), last - first + 1)
                    here = {low + b.a + i for b in blocks for i in range(b.size)}
                    there = {b.b + i for b in blocks for i in range(b.size)}
                    numbers = len(template) <= SHORT
                    same = marks(template, numbers) <= there and {first + i for i in marks(words[first : last + 1], numbers)} <= here
                    if same and share >= LEAST_EQUAL:
                        found.append((doc_id.as_py(), span["license"], first, last, span["votes"], round(share, 6), equal, max(len(template), last - first + 1)))
                rows += best_spans(found)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "license", "first_word", "last_word", "votes", "equal"])

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, first_word, last_word, votes, equal) of every verified span; words count from 0.

    Templates of fewer than GRAM words are never found. A null doc_id stays null; null,
    empty and short texts have no spans; very long ones are read whole, in slices of their
    own. Of templates that tie on one span that of the least name is kept. Rows repeated with
    one doc_id and text give their spans once. A text may hold several spans, also of one license. An empty table gives no
    rows. Columns besides doc_id and text are not read.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    runs = template_runs(templates)
    known = spark.createDataFrame(runs, "run long, license string, t_place int, t_runs int")
    slim = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("content"), F.col("text").cast("string").alias("text"))
    every = slim.mapInArrow(_all_runs, "doc_id long, content long, place int, run long")
    hits = every.join(F.broadcast(known) if len(runs) * 64 <= BROADCAST_BYTES else known, "run")
    lines = hits.distinct().groupBy("doc_id", "content", "license", "t_runs", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("t_place").alias("t_first"), F.max("t_place").alias("t_last"))
    own = Window.partitionBy("doc_id", "content", "license").orderBy("first", "diagonal")
    parted = (F.abs(F.col("diagonal") - F.lag("diagonal").over(own)) > NEAR_DIAGONALS) | (F.col("first") - F.lag("last").over(own) > GAP)
    numbered = lines.withColumn("new", F.coalesce(parted, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "content", "license", "span").agg(F.max("t_runs").alias("t_runs"), F.sum("votes").cast("int").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last"))
    enough = spans.where(F.col("votes") >= F.col("t_runs") * LEAST_VOTES)
    listed = materialise(enough.groupBy("doc_id", "content").agg(F.sort_array(F.collect_list(F.struct("license", "first", "last", "t_first", "t_last", "votes"))).alias("spans")).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), "spans"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("content") == F.col("__content"))
    found = join_checked(slim, listed, on, "inner", 96 + 96 * F.size("spans")).select("doc_id", "text", "spans")
    return found.mapInArrow(_verifier(templates), "doc_id long, license string, first_word int, last_word int, votes int, equal double").distinct()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2}
SQL: dict[str, str] = {}
