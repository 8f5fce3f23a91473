"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import lmscore, minhash, neighbours, packing, periodic, pieces, pii, prefixes, quality, repetition, runindex, sentences, tokenfile
from .spaces import read


def op1_packing(spark, sf_dir):
    return packing.contract(read(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality.contract(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_lmscore(spark, sf_dir):
    return lmscore.contract(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_minhash(spark, sf_dir):
    return minhash.contract(read(spark, sf_dir, "documents"))


def op5_pieces(spark, sf_dir):
    return pieces.digests(read(spark, sf_dir, "documents"))


def op6_tokenfile(spark, sf_dir):
    return tokenfile.contract(read(spark, sf_dir, "documents"))


def op7_neighbours(spark, sf_dir):
    return neighbours.contract(read(spark, sf_dir, "embeddings"))


def op8_pii(spark, sf_dir):
    return pii.contract(read(spark, sf_dir, "documents"))


def op9_repetition(spark, sf_dir):
    return repetition.repetition_rules(read(spark, sf_dir, "documents"))


def op10_sentences(spark, sf_dir):
    return sentences.contract(read(spark, sf_dir, "documents"))


def op11_prefixes(spark, sf_dir):
    return prefixes.contract(read(spark, sf_dir, "conversations"))


def op12_runindex(spark, sf_dir):
    return runindex.contract(read(spark, sf_dir, "documents"))


def op13_periodic(spark, sf_dir):
    return periodic.contract(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_lmscore, op4_minhash, op5_pieces, op6_tokenfile, op7_neighbours, op8_pii, op9_repetition, op10_sentences, op11_prefixes, op12_runindex, op13_periodic)}

OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(min(n), 0)::BIGINT AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_minhash": OP4}
