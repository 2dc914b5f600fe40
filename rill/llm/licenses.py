"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Templates and texts are lower-cased, freed of quotes, brackets and stops, and cut into shingles of five words.
A template is cut into overlapping chunks. A text gives its windows of each chunk's length, from every word on; those
that share no shingle with any template have similarity zero with every chunk and are passed over. Signatures of 32
minima make 16 bands of two; a template is retrieved if a band of a window equals one of a chunk. A window that shares
80 % of its shingles with a chunk of its own length has a Jaccard similarity of 2/3 at least, and is found with
probability 1 - (1 - (2/3)^2)^16 > 0.9999; an equal one always. Retrieved templates are verified on the whole
text: the share of a template's different shingles that the text contains, at least `THRESHOLD`.

All of it is one narrow stage of native expressions: a text's windows are compared with the templates' bands,
which are constants bounded by the list of templates. Nothing is shuffled, so no text or line can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.llm.common import words

SHINGLE, THRESHOLD = 5, 0.8
CHUNK, STRIDE = 16, 8
BANDS, ROWS = 16, 2
STRIPPED = ",;:()[]\"'“”<>"

#: Texts and paragraphs of public licenses, standard headers, and notices that name them.
TEMPLATES = {
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "boost-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:"
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-disclaimer": (
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
        "SUCH DAMAGE."
    ),
    "bsd-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."
    ),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
}


def bare(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), STRIPPED, "")


def normal_words(text: Column) -> Column:
    return words(F.regexp_replace(bare(text), r"\.+([\x20\x09-\x0D]|$)", "$1"))


def shingles(w: Column) -> Column:
    """Different runs of five words; none of shorter texts."""
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def shingle_hashes(w: Column) -> Column:
    """Hash of the run of five words from each word on."""
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))


def band_keys(windows: Column) -> Column:
    """Band keys of all windows, each an array of shingle hashes."""
    seeds = F.array(*map(F.lit, range(BANDS * ROWS)))
    least = lambda hashes: F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))
    key = lambda m: F.array(*(F.xxhash64(F.lit(b), *(F.get(m, F.lit(b * ROWS + r)) for r in range(ROWS))) for b in range(BANDS)))
    return F.flatten(F.transform(F.transform(windows, least), key))


def chunk_spans(n: int) -> list[tuple[int, int]]:
    """(start, words) of a template's chunks: the whole, if short, else overlapping ones that reach its end."""
    if n <= CHUNK:
        return [(0, n)]
    return [(s, CHUNK) for s in range(0, n - CHUNK, STRIDE)] + [(n - CHUNK, CHUNK)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_matched, n_shingles, containment) for each row of `docs` (doc_id, text) and template found.

    Null, empty and short texts have none. Repeated rows and null ids are reported each. No templates, no rows.
    Templates need five words at least.
    """
    spark: SparkSession = docs.sparkSession
    named = sorted((TEMPLATES if templates is None else templates).items())
    listed = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in named)) if named else None
    if listed is None:
        return docs.select(F.col("doc_id").cast("long"), *(F.lit(None).cast(t).alias(c) for c, t in _RESULT)).limit(0)
    w = spark.range(1).select(F.inline(listed)).withColumn("w", normal_words(F.col("text")))
    parts = w.withColumn("s", shingles(F.col("w"))).withColumn("h", shingle_hashes(F.col("w"))).collect()
    if any(not r["s"] for r in parts):
        raise ValueError("a template needs five words")
    chunks = [(r["license"], r["w"][s : s + n], r["h"][s : s + n - SHINGLE + 1]) for r in parts for s, n in chunk_spans(len(r["w"]))]
    lengths, hashes = sorted({len(c[1]) for c in chunks}), sorted(set().union(*(r["h"] for r in parts)))
    longs = lambda xs: F.array(*map(F.lit, xs))
    keyed = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("license"), longs(h).alias("h")) for k, _, h in chunks))))
    bands = keyed.groupBy("license").agg(F.array_distinct(F.flatten(F.collect_list(band_keys(F.array("h"))))).alias("keys")).collect()
    keys = {r["license"]: r["keys"] for r in bands}
    known = F.array(*(
        F.struct(F.lit(r["license"]).alias("license"), longs(keys[r["license"]]).alias("keys"), longs(r["s"]).alias("s")) for r in parts
    ))
    w, h, at = F.col("rill_w"), F.col("rill_h"), F.col("rill_at")
    known_at = F.filter(F.transform(h, lambda x, i: F.when(x.isin(hashes), i)), lambda i: i.isNotNull())
    from_ = lambda n: F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), p - (n - SHINGLE)), p))))
    cut = lambda n: F.filter(F.transform(from_(n), lambda s: F.slice(h, s + 1, n - SHINGLE + 1)), lambda x: F.size(x) > 0)
    windows = F.array_distinct(F.concat(*map(cut, lengths)))
    retrieved = F.filter(known, lambda t: F.arrays_overlap(t["keys"], F.col("rill_keys")))
    matched = lambda t: F.size(F.array_intersect(t["s"], F.col("rill_s")))
    verified = F.transform(retrieved, lambda t: F.struct(
        t["license"].alias("license"), matched(t).cast("long").alias("n_matched"), F.size(t["s"]).cast("long").alias("n_shingles")
    ))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = texts.withColumn("rill_w", normal_words(F.col("text"))).withColumn("rill_h", shingle_hashes(w))
    # the one-element explosion keeps the filter above it, so that places are looked for once
    sharing = hashed.withColumn("rill_at", F.explode(F.array(known_at))).where(F.size("rill_at") > 0)
    found = (
        sharing.withColumn("rill_windows", windows).withColumn("rill_keys", band_keys(F.col("rill_windows"))).withColumn("rill_s", shingles(w))
        .select("doc_id", F.explode_outer(verified).alias("rill_found"))  # outer: the filter below then stays above it
    )
    containment = (F.col("n_matched") / F.col("n_shingles")).alias("containment")
    return found.select("doc_id", "rill_found.*").where(F.col("n_matched") >= THRESHOLD * F.col("n_shingles")).select("*", containment)


_RESULT = (("license", "string"), ("n_matched", "long"), ("n_shingles", "long"), ("containment", "double"))
