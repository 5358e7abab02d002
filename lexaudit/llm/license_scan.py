"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only.  A block is a window of ``window`` consecutive words, one every
``window / 2`` words, so every run of ``window / 2`` words lies whole in a block, however the
text is cut into lines.  A block meets a template if it holds at least ``threshold`` of the
template's distinct words.  The join is exact:

* tokens are ordered by their frequency over all documents, rarest first;
* a block that meets a template of n words with ``need`` of them shares one of the template's
  first ``n - need + 1`` words (prefix filter), has ``need`` template words at all (length
  filter), and enough words after the shared ones on both sides (positional filter);
* candidates are verified by counting the common words.

Only words of the templates can match, so blocks are reduced to these before anything moves;
the index of template prefixes is broadcast because it is bounded by the template list
(checked against ``max_template_words``).  Documents are never shuffled; what moves is one
narrow row a document after a map-side combine.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import restored, set_aside

#: Phrases of the base scan and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of public license notices by label, in lower case without punctuation.
TEMPLATES = {
    "apache-2": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-sa-4": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: What separates words: every ASCII character but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """The words, each between single spaces; one space where there are none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))
    return F.when(t == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def _places(norm: str, low: str, phrase: str) -> Column:
    """{n, first, last} of the places of a phrase; words are counted by the spaces before them."""
    n_words = len(phrase.split(" "))
    pieces = F.split(F.col(norm), f"(?i) {phrase}(?= )", -1)
    last = F.element_at(pieces, -1)
    found = F.struct(
        (F.size(pieces) - 1).cast("long").alias("n"),
        _spaces(F.element_at(pieces, 1)).cast("long").alias("first"),
        (_spaces(F.col(norm)) - F.lit(n_words) - _spaces(last)).cast("long").alias("last"),
    )
    return F.when(F.contains(F.col(low), F.lit(f" {phrase} ")), found)


def scan_licenses(docs: DataFrame, *, text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, window: int = 128, max_template_words: int = 100_000) -> DataFrame:
    """docs without text, with n_words, n_base, first_word, last_word, base_labels, labels and score appended.

    n_base counts all places of all phrases; first_word and last_word are their smallest and
    largest start (null without any).  labels has those of the phrases and of every template
    that a block meets; score is 1 for a phrase, else the largest share of a template that a
    block holds, if it reaches the threshold, else 0.  A null text counts as empty: no words,
    no labels, score 0.  Repeated rows are scanned one by one; columns whose names clash with
    the new ones are replaced; an empty table gives an empty one.  phrases and templates are
    given in lower case with single spaces.
    """
    sets = {k: sorted(set(v.split())) for k, v in templates.items()}
    vocab = sorted(set().union(*sets.values())) if sets else []
    if len(vocab) > max_template_words:
        raise ValueError(f"templates have over {max_template_words} words")
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new or c.lower() == text.lower()))
    own, names_kept, keep = set_aside(own, text)
    half = window // 2
    base = own.select(*keep, F.monotonically_increasing_id().alias("_rid"), normalised(F.col(text)).alias("_norm")).withColumn("_low", F.lower("_norm"))
    tokens = F.array_intersect(F.split("_low", " "), F.array(*map(F.lit, vocab)) if vocab else F.array().cast("array<string>"))
    # document frequencies of the templates' words over all documents; as many rows as the templates have words
    df = {r[0]: r[1] for r in base.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()} if vocab else {}
    rank = {t: i for i, t in enumerate(sorted(vocab, key=lambda t: (df.get(t, 0), t)))}
    index, all_prefix = [], set()
    for label, words in sets.items():
        words = sorted(words, key=rank.get)
        need = max(1, -(-round(threshold * len(words) * 1_000_000) // 1_000_000))
        for i, w in enumerate(words[: len(words) - need + 1]):
            index.append((rank[w], label, i, len(words), need, [rank[x] for x in words]))
            all_prefix.add(w)
    least = min((x[4] for x in index), default=1)
    idx = docs.sparkSession.createDataFrame(index, "_t int, _label string, _i int, _size int, _need int, _set array<int>")
    ranks = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv)) if rank else F.create_map().cast("map<string,int>")
    places = [F.col(f"_p{i}") for i in range(len(phrases))]
    d = base.withColumn("_toks", tokens)
    may = (F.size("_toks") >= least) & F.arrays_overlap("_toks", F.array(*map(F.lit, sorted(all_prefix)))) if all_prefix else F.lit(False)
    d = d.select(
        *keep,
        "_rid",
        *(_places("_norm", "_low", p).alias(f"_p{i}") for i, p in enumerate(phrases)),
        F.greatest(_spaces(F.col("_norm")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.when(may, F.split(F.translate(F.trim("_norm"), UPPER, LOWER), " ")).alias("_words"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1 - half, F.lit(0)), F.lit(half))
    d = d.withColumn("_block", F.explode_outer(F.when(F.col("_words").isNotNull(), F.transform(starts, lambda s: F.slice(F.col("_words"), s + 1, window)))))
    in_block = F.array_sort(F.array_distinct(F.filter(F.transform("_block", lambda w: ranks[w]), lambda r: r.isNotNull())))
    d = d.drop("_words").withColumn("_set_b", in_block).drop("_block").withColumn("_set_b", F.when(F.size("_set_b") >= least, F.col("_set_b")))
    d = d.select("*", F.posexplode_outer("_set_b").alias("_j", "_t"))
    j = d.join(F.broadcast(idx), "_t", "left")
    # positional filter, then verification
    possible = F.lit(1) + F.least(F.col("_size") - F.col("_i") - 1, F.size("_set_b") - F.col("_j") - 1) + F.least("_i", "_j") >= F.col("_need")
    common = F.when(possible, F.size(F.array_intersect("_set", "_set_b")))
    meets = F.when(common >= F.col("_need"), F.struct(F.col("_label").alias("l"), (common / F.col("_size")).alias("s")))
    carry = [*keep, "n_words", *(f"_p{i}" for i in range(len(phrases)))]
    g = j.withColumn("_m", meets).groupBy("_rid").agg(*(F.first(c).alias(c) for c in carry), F.collect_set("_m.l").alias("_labels"), F.max("_m.s").alias("_s"))
    n_base = sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0).cast("long"))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(p.isNotNull(), F.lit(v)) for p, v in zip(places, phrases.values(), strict=True)))))) if places else F.array().cast("array<string>")
    lo = F.array_min(F.array(*(p["first"] for p in places))) if places else F.lit(None).cast("long")
    hi = F.array_max(F.array(*(p["last"] for p in places))) if places else F.lit(None).cast("long")
    return g.select(
        *restored(names_kept, keep),
        "n_words",
        n_base.alias("n_base"),
        lo.alias("first_word"),
        hi.alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, "_labels")), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_s", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs)


def _sql() -> str:
    q = lambda s: "'" + s + "'"
    templates = ", ".join(f"({q(k)}, string_split({q(v)}, ' '))" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"(string_split({q(k)}, ' '), {q(v)})" for k, v in PHRASES.items())
    return f"""
WITH t AS (SELECT label, list_distinct(w) AS w FROM (VALUES {templates}) AS v(label, w)),
ph AS (SELECT * FROM (VALUES {phrases}) AS v(w, label)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
hit AS (SELECT rid, p.label, i FROM d, ph AS p, unnest(range(0, len(d.w))) AS u(i) WHERE d.w[i + 1] = p.w[1] AND d.w[i + 1 : i + len(p.w)] = p.w),
base AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS b, list_sort(list(DISTINCT label)) AS l FROM hit GROUP BY rid),
blocks AS (SELECT rid, d.w[s * 64 + 1 : s * 64 + 128] AS b FROM d, unnest(range(0, greatest(0, len(d.w) - 65) // 64 + 1)) AS u(s) WHERE len(d.w) > 0),
met AS (SELECT rid, label, len(list_intersect(b, t.w)) / len(t.w) AS s FROM blocks, t WHERE len(list_intersect(b, t.w)) >= ceil(0.8 * len(t.w) - 1e-6)),
m AS (SELECT rid, list(DISTINCT label) AS l, max(s) AS s FROM met GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(coalesce(base.l, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(m.l, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)"""


OP10_SQL = _sql()
