"""Registered queries of the subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import fingerprint, html, idfiles, jaccard, licenses, lm, negatives, packing, pieces, quality, runs, search, toxicity
from firnline.llm.common import remainder, table
from firnline.session import new_path


TOPK_SQL = """
WITH bits AS (SELECT vec_id, i, embedding[i] > 0 AS bit FROM embeddings, range(1, 65) AS t(i)),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(CASE WHEN q.bit <> b.bit THEN 1 ELSE 0 END) AS INTEGER) AS distance
  FROM bits q JOIN bits b ON q.i = b.i WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, b.vec_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM p
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, l.b FROM reach JOIN l ON reach.r = l.a),
lowest AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT lowest.d AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, lowest.r AS component_id FROM lowest LEFT JOIN n ON n.doc_id = lowest.d
"""


def _license_runs() -> str:
    """Rows (id, label, exact, runs, place, g, vote, decides, needed) as the operator has them, with the words of each run."""
    k = licenses.RUN_WORDS

    def runs(text: str) -> list[str]:
        w = text.split()
        return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]

    rows = []
    given = [(label, text, True) for label, text in licenses.PHRASES] + [(label, text, False) for label, text in licenses.TEMPLATES + licenses.MORE_TEMPLATES]
    for number, (label, text, exact) in enumerate(given):
        own = runs(text)
        lists = [] if exact else [[g for wording in wordings for g in runs(wording)] for wordings in licenses.DECIDING.get(label, [])]
        bits = {g: sum(1 << b for b, deciding in enumerate(lists) if g in deciding) for g in own}
        head = f"{number}, '{label}', {exact}, {len(own)}"
        rows += [f"({head}, {p}, '{g}', 1, {bits[g]}, {(1 << len(lists)) - 1})" for p, g in enumerate(own)]
        # Deciding runs of another wording stand where the template has its own, without a vote.
        for b, deciding in enumerate(lists):
            place = min(p for p, g in enumerate(own) if g in deciding)
            rows += [f"({head}, {place}, '{g}', 0, {1 << b}, {(1 << len(lists)) - 1})" for g in dict.fromkeys(deciding) if g not in bits]
    return ", ".join(rows)


def _license_sql() -> str:
    k = licenses.RUN_WORDS

    def labels(of: str) -> str:
        return f"coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE {of})), ','), '')"

    return f"""
WITH tg(id, label, exact, runs, place, g, vote, decides, needed) AS (VALUES {_license_runs()}),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
dp AS (SELECT doc_id, w, unnest(range(0, len(w) - {k - 1})) AS p FROM w WHERE len(w) >= {k}),
dg AS (SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + {k}), ' ') AS g FROM dp),
votes AS (
  SELECT doc_id, id, label, exact, runs, needed, p - place AS diagonal, sum(vote) AS votes, bit_or(decides) AS decides, min(place) AS low, max(place) AS high
  FROM dg JOIN tg ON dg.g = tg.g GROUP BY doc_id, id, label, exact, runs, needed, p - place
),
begun AS (
  SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, id ORDER BY diagonal) > {licenses.DIAGONAL_GAP}, true) THEN 1 ELSE 0 END AS begins FROM votes
),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS span FROM begun),
spans AS (
  SELECT doc_id, id, label, exact, runs, needed, span, sum(votes) AS votes, bit_or(decides) AS decides, min(diagonal + low) AS first, max(diagonal + high + {k - 1}) AS last
  FROM numbered GROUP BY doc_id, id, label, exact, runs, needed, span
),
found AS (
  SELECT *, least(votes * 1e0 / runs, 1e0) AS cover FROM spans
  WHERE CASE WHEN exact THEN votes = runs ELSE decides = needed AND least(votes * 1e0 / runs, 1e0) >= {licenses.LEAST_COVER} AND last - first + 1 <= {licenses.MOST_STRETCH}e0 * (runs + {k - 1}) END
),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word,
    {labels("exact")} AS base_labels, {labels("true")} AS labels, max(cover) AS score
  FROM found GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM w LEFT JOIN by_doc ON w.doc_id = by_doc.doc_id
"""


NEGATIVES_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS rank FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.rank <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


# A run of at least 24 words and three periods repeats at least 16 words at its period, so equal 8-grams at that distance find it.
# crc32 is made bit by bit from the digits of the id.
RUNS_SQL = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS bits
  FROM documents
),
h AS (
  SELECT doc_id, w, len(w) AS n,
    xor(list_reduce(bits, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h
  FROM t
),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS cut FROM h),
p AS (SELECT *, 1 + (n - a) // cut AS p FROM g),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
k AS (SELECT doc_id, n, w, unnest(range(n - 7)) AS i FROM e WHERE n >= 24),
k8 AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 8], ' ') AS k FROM k),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k8 x JOIN k8 y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i WHERE 3 * (y.i - x.i) <= x.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::HUGEINT * 1000000000000 // period DESC, start, period) AS rank FROM r),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, length * 1000 // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM e LEFT JOIN told USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, dims=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(3) == 1
    return quality.classify(docs, labels, ~held_out).withColumn("held_out", held_out)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).drop("mark")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(7) == 2
    return lm.score(table(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(5) == 0
    found = toxicity.classify(docs, labels, ~held_out)
    return found.withColumn("held_out", held_out).withColumn("n_spans", F.size("spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def op12_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-id-files")
    idfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.read(spark, path)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs of which about every tenth (by the hash of its id) goes on, from some word, with copies of the words from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    of = F.col
    words = docs.withColumn("h", h).withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    at = words.withColumn("n", F.size("words")).withColumn("g", F.floor(of("h") / 10)).withColumn("a", (of("g") % of("n")).cast("int"))
    at = at.withColumn("p", (1 + F.floor((of("n") - of("a")) / (3 + of("g") % 8))).cast("int")).withColumn("times", F.ceil((of("n") - of("a")) / of("p")).cast("int"))
    copies = F.slice(F.flatten(F.array_repeat(F.slice("words", of("a") + 1, of("p")), of("times"))), F.lit(1), of("n") - of("a"))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), of("a")), copies), " ")
    return at.select("doc_id", F.when(of("words").isNotNull() & (of("n") > 0), edited).otherwise(of("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_digests(runs.scan(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_topk_search": op2_topk_search,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_html_text": op7_html_text,
        "op8_lm_scores": op8_lm_scores,
        "op9_toxicity": op9_toxicity,
        "op10_license_scan": op10_license_scan,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_token_id_files": op12_token_id_files,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": TOPK_SQL, "op6_ngram_jaccard_join": JACCARD_SQL, "op10_license_scan": _license_sql(), "op11_hard_negatives": NEGATIVES_SQL, "op13_periodic_runs": RUNS_SQL}
