"""License scans by diagonal voting.

Every k-word run of every text is hashed in the tasks, and Spark joins all of them to the places at which the same run stands in
a template. A hit votes for the diagonal (place in the text - place in the template). Votes are added up by diagonal,
neighbouring diagonals of one template are merged (inserted or missing words move a diagonal), and a merged span counts if it
covers enough of the template, is not much longer than it and holds the runs that tell its license from others (DECIDING). Short phrases are templates whose every run must be there on one
diagonal.

Defined cases: NULL text counts as empty; a text without words has no place and score 0; a repeated id is one document per
row, rows are told apart; an empty table gives an empty result; other columns are ignored. A NULL id stays NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm import flat
from firnline.llm.common import column, map_batches

#: Words of a run. The shortest phrase has as many.
RUN_WORDS = 3
#: Diagonals at most so far apart are one passage.
DIAGONAL_GAP = 4
#: Share of a template's runs that a passage must cover, and how many times the template's length it may be.
LEAST_COVER = 0.5
MOST_STRETCH = 1.6

# Phrases of the base and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening words of public licenses and usual notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

# Notices that the SQL of the query does not have.
MORE_TEMPLATES = [
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
]

_VERSIONS = ["4 0", "3 0", "2 5", "2 1", "2 0", "1 0"]

#: Runs that tell licenses of like words apart: of each list a passage must hold one, or it does not get the label.
DECIDING = {
    "apache-2": [["version 2 0", "license version 2"]],
    "gpl-3": [["gnu general public"], ["version 3 of", "license version 3"]],
    "gpl-2": [["gnu general public"], ["version 2 of", "license version 2"]],
    "cc-by-nc": [["cc by nc", *(f"attribution noncommercial {v[0]}" for v in _VERSIONS)]],
    "cc-by-sa": [[f"attribution sharealike {v[0]}" for v in _VERSIONS]],
    "cc-by": [[f"attribution {v}" for v in _VERSIONS]],
}

#: Hash that stands for the document itself, so that one join gives hits and documents.
_DOCUMENT = 0


def _word_hashes(texts: pa.Array) -> Iterator[tuple[flat.Flat, flat.Tokens, np.ndarray]]:
    for part in flat.slices(texts):
        low = flat.LOWER[part.data]
        words = flat.tokens(part, flat.ALNUM[low].astype(np.uint8))
        yield part, words, flat.hashes(low, words.starts, words.ends)


def template_places(spark, phrases=PHRASES, templates=TEMPLATES + MORE_TEMPLATES, k: int = RUN_WORDS) -> DataFrame:
    """(hash, template, place, label, exact, runs, vote, decides, needed): one row per run of each template, and per deciding run that it lacks.

    decides has the bits of the deciding lists that hold the run; a passage needs all bits of needed. A deciding run of another
    wording has no vote and stands where the template has its own.
    """
    rows = [(_DOCUMENT, -1, 0, "", False, 1, 1, 0, 0)]
    for i, (label, text, exact) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        lists = [] if exact else DECIDING.get(label, [])
        runs, at = _hashed_runs(text, k)
        bits, others = dict.fromkeys(runs, 0), {}
        for bit, wordings in enumerate(lists):
            deciding = [x for wording in wordings for x in _hashed_runs(wording, k)[0]]
            own = min(p for x, p in zip(runs, at) if x in deciding)
            for x in deciding:
                if x in bits:
                    bits[x] |= 1 << bit
                else:
                    others[x] = (own, 1 << bit)
        needed = (1 << len(lists)) - 1
        rows += [(x, i, p, label, exact, len(runs), 1, bits[x], needed) for x, p in zip(runs, at)]
        rows += [(x, i, p, label, exact, len(runs), 0, bit, needed) for x, (p, bit) in others.items()]
    return spark.createDataFrame(rows, "hash long, template int, place int, label string, exact boolean, runs int, vote int, decides int, needed int")


def _hashed_runs(text: str, k: int) -> tuple[list[int], list[int]]:
    _, words, h = next(_word_hashes(pa.array([text])))
    runs, at = flat.runs(h, words.doc, k)
    return [int(x) for x in runs.view(np.int64)], [int(p) for p in at]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = RUN_WORDS) -> DataFrame:
    """(doc_id, row, at, hash) for every run of every text, and a row with hash 0 per text whose `at` is its number of words.

    row tells rows of the same id apart.
    """

    def work(batch: pa.RecordBatch):
        ids, rows = column(batch, "doc_id"), column(batch, "row")
        for part, words, h in _word_hashes(column(batch, "text")):
            runs, first = flat.runs(h, words.doc, k)
            runs = np.where(runs == _DOCUMENT, np.uint64(1), runs)
            which = np.concatenate([np.arange(len(part)), words.doc[first]]) + part.first
            at = np.concatenate([words.counts, words.place()[first]])
            take = pa.array(which)
            yield {"doc_id": ids.take(take), "row": rows.take(take), "at": at, "hash": np.concatenate([np.full(len(part), _DOCUMENT), runs.view(np.int64)])}

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return map_batches(given, work, "doc_id long, row long, at long, hash long")


def license_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages (doc_id, row, template, label, exact, first, last, cover), and a row of template -1 per document whose diagonal is its number of words.

    first and last are word places; a phrase gives one passage per place it stands at.
    """
    places = template_places(docs.sparkSession)
    # As many rows as the templates have words: a size known beforehand.
    hits = word_runs(docs, id_col, text_col).join(F.broadcast(places), "hash")
    votes = hits.groupBy("doc_id", "row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.sum("vote").alias("votes"), F.bit_or("decides").alias("decides"), F.first("needed").alias("needed"), F.min("place").alias("low"), F.max("place").alias("high"),
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("runs").alias("runs"),
    )
    by_template = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    # A phrase stands only where all its runs vote for one diagonal, so its diagonals are never merged.
    starts = F.col("exact") | (F.col("template") < 0) | (F.col("diagonal") - F.lag("diagonal", 1).over(by_template) > DIAGONAL_GAP)
    spans = (
        votes.withColumn("span", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by_template))
        .groupBy("doc_id", "row", "template", "span")
        .agg(
            F.sum("votes").alias("votes"), F.bit_or("decides").alias("decides"), F.first("needed").alias("needed"), F.min(F.col("diagonal") + F.col("low")).alias("first"),
            F.max(F.col("diagonal") + F.col("high") + RUN_WORDS - 1).alias("last"), F.first("label").alias("label"),
            F.first("exact").alias("exact"), F.first("runs").alias("runs"), F.max("diagonal").alias("diagonal"),
        )
    )
    cover = F.least(F.col("votes") / F.col("runs"), F.lit(1.0))
    length = F.col("last") - F.col("first") + 1
    verified = F.when(F.col("exact"), F.col("votes") == F.col("runs")).otherwise(
        (F.col("decides") == F.col("needed")) & (cover >= LEAST_COVER) & (length <= MOST_STRETCH * (F.col("runs") + RUN_WORDS - 1))
    )
    return spans.withColumn("cover", cover).filter((F.col("template") < 0) | verified)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score (cover of its best passage, 1 for a phrase)."""
    spans = license_passages(docs, id_col, text_col)
    document, base = F.col("template") < 0, F.col("exact")
    found = ~document

    def labels(of):
        return F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")

    return spans.groupBy("doc_id", "row").agg(
        F.max(F.when(document, F.col("diagonal"))).alias("n_words"),
        F.count(F.when(found & base, 1)).alias("n_base"),
        F.min(F.when(found & base, F.col("first"))).alias("first_word"),
        F.max(F.when(found & base, F.col("first"))).alias("last_word"),
        labels(found & base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("cover"))), F.lit(0.0)).alias("score"),
    ).drop("row")
