"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.backtrack import encode_decode
from tablescope.llm.bpe import bpe_round_trip
from tablescope.llm.collocations import collocations
from tablescope.llm.embeddings import near_embeddings
from tablescope.llm.html import extract
from tablescope.llm.imatch import fingerprints
from tablescope.llm.minhash import near_duplicates
from tablescope.llm.mixing import mix
from tablescope.llm.periods import periodic_runs, repeated_tail, strongest
from tablescope.llm.quality import quality_scores, remainder
from tablescope.llm.scratch import Scratch
from tablescope.llm.tokens import read_token_files, write_token_files
from tablescope.llm.toxicity import toxicity_scores
from tablescope.llm.warc import read_warc, write_warc
from tablescope.llm.workers import importable

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op1"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder, manifest = write_token_files(docs, Scratch(spark, "op2"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, added_tokens=True)
    return read_token_files(folder, manifest)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"), Scratch(spark, "op3"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_warc(_table(spark, sf_dir, "pages"), Scratch(spark, "op4"))
    return read_warc(folder, manifest).drop("url")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = quality_scores(docs, docs, labels, remainder(F.col("id"), 4) != 2)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # The query's contract asks for shingles of four words.
    return near_duplicates(docs, Scratch(spark, "op7"), words=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity_scores(docs, docs, labels, remainder(F.col("id"), 5) != 0)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mix(docs, Scratch(spark, "op9")).select("doc_id", "size", "source_size", "target", "taken")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), Scratch(spark, "op12")).drop("example")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = periodic_runs(docs.select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text")))
    best = strongest(F.col("runs"))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = told.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), line.alias("lines"))
    return told.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_embedding_near_dedup, op2_token_files, op3_html_extraction, op4_warc, op5_quality_classifier, op6_byte_level_bpe, op7_minhash_near_dedup, op8_toxicity, op9_mixing,
        op10_document_fingerprints, op11_backtracking_bpe, op12_collocations, op13_periodic_runs,
    )
    return {f.__name__: f for f in named}


_REACH = (
    "reach AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x), "
    "classes AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"
)

# All pairs of vectors; the tables hold finite vectors of one length only.
EMBEDDINGS_SQL = (
    "WITH RECURSIVE links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND "
    "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95), ids AS (SELECT vec_id AS id FROM embeddings), "
    f"{_REACH} SELECT id AS vec_id, (SELECT count(*) FROM links WHERE x = id) AS n_links, component_id, id = component_id AS kept FROM classes"
)

WARC_SQL = (
    "WITH p AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha256(COALESCE(html, '')) AS d FROM pages), "
    "f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d) "
    "SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, "
    "CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (d)"
)

# All pairs of documents that share a shingle.
MINHASH_SQL = (
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
    "s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN "
    "range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)), "
    "n AS (SELECT doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id), "
    "common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL), "
    "links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)), "
    f"ids AS (SELECT doc_id AS id FROM documents), {_REACH} "
    "SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN classes ON id = doc_id"
)

# All phrases of one to three words, on 128-bit numbers.
COLLOCATIONS_SQL = (
    "WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
    "w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p), "
    "o AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)), "
    "c AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang), "
    "d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10), "
    "b AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM d, (VALUES (1), (2)) AS s(i) WHERE k = 3 GROUP BY ALL), "
    "e AS (SELECT d.* FROM d LEFT JOIN b USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a), "
    "x AS (SELECT e.lang, e.phrase, e.a, i, y.f AS l, z.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score FROM e, (VALUES (1), (2)) AS s(i), "
    "c AS y, c AS z WHERE i < e.k AND y.lang = e.lang AND y.phrase = array_to_string(ws[1:i], ' ') AND z.lang = e.lang AND z.phrase = array_to_string(ws[i + 1:], ' ')), "
    "m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1) "
    "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m JOIN t USING (lang) QUALIFY rank <= 2000"
)


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": EMBEDDINGS_SQL, "op4_warc": WARC_SQL, "op7_minhash_near_dedup": MINHASH_SQL, "op12_collocations": COLLOCATIONS_SQL}
