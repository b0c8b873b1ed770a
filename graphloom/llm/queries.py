"""Queries on training-data operators, with their SQL where SQL can tell."""

from __future__ import annotations

from graphloom.llm import cooccur, encode, handwritten, leakage, parsecheck, stuffing, topn
from graphloom.session import table


def _symbol_rows(spark, sf_dir):
    return cooccur.records(
        [
            (table(spark, sf_dir, "semantic_links"), ["from_file", "to_file"], "via_symbols"),
            (table(spark, sf_dir, "file_concepts"), ["concept_id"], "shared_symbols"),
        ]
    )


def p1_found(spark, sf_dir):
    return cooccur.pair_counts(_symbol_rows(spark, sf_dir), min_pairs=6, min_lift=3).select("repo_id", "symbol_a", "symbol_b")


def p1_lift(spark, sf_dir):
    """Every pair that is held together at all, with its lift."""
    return cooccur.pair_counts(_symbol_rows(spark, sf_dir)).selectExpr("repo_id", "symbol_a", "symbol_b", "n_ab", "n_a", "n_b", "n_records", "round(lift, 6) AS lift")


def p4_found(spark, sf_dir):
    return handwritten.not_handwritten(table(spark, sf_dir, "parse_work")).select("work_id")


def p4_kinds(spark, sf_dir):
    return handwritten.not_handwritten(table(spark, sf_dir, "parse_work"))


def p5_found(spark, sf_dir):
    return topn.top_items(table(spark, sf_dir, "batch_results"))


def p7_ids(spark, sf_dir):
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p6_found(spark, sf_dir):
    return parsecheck.unparsable(table(spark, sf_dir, "parse_work")).select("work_id")


def p6_rates(spark, sf_dir):
    return parsecheck.rates(table(spark, sf_dir, "parse_work"))


def p8_found(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark, sf_dir):
    """Every document, without the spans that leaked into it."""
    return leakage.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return stuffing.find_stuffed(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_lift": p1_lift, "p4_found": p4_found, "p4_kinds": p4_kinds, "p5_found": p5_found, "p6_found": p6_found, "p6_rates": p6_rates, "p7_ids": p7_ids, "p8_found": p8_found, "p8_clean": p8_clean, "p9_found": p9_found}

_PAIRS = """
WITH raw AS (
  SELECT repo_id, 'L' || coalesce(from_file, chr(1)) || chr(0) || coalesce(to_file, chr(1)) AS rec, via_symbols AS syms FROM semantic_links WHERE repo_id IS NOT NULL
  UNION ALL SELECT repo_id, 'C' || coalesce(concept_id::VARCHAR, chr(1)), shared_symbols FROM file_concepts WHERE repo_id IS NOT NULL),
n AS (SELECT repo_id, count(DISTINCT rec) AS n_records FROM raw GROUP BY 1),
x AS (SELECT DISTINCT repo_id, rec, trim(s, ' ' || chr(9)) AS sym FROM (SELECT repo_id, rec, unnest(syms) AS s FROM raw) WHERE trim(s, ' ' || chr(9)) <> ''),
c AS (SELECT repo_id, sym, count(*) AS k FROM x GROUP BY 1, 2),
p AS (SELECT a.repo_id, a.sym AS symbol_a, b.sym AS symbol_b, count(*) AS n_ab
  FROM x a JOIN x b ON a.repo_id = b.repo_id AND a.rec = b.rec AND a.sym < b.sym GROUP BY 1, 2, 3),
f AS (SELECT p.repo_id, symbol_a, symbol_b, n_ab, ca.k AS n_a, cb.k AS n_b, n_records
  FROM p JOIN c ca ON ca.repo_id = p.repo_id AND ca.sym = symbol_a JOIN c cb ON cb.repo_id = p.repo_id AND cb.sym = symbol_b JOIN n ON n.repo_id = p.repo_id)
"""

ORACLE = {
    "p1_found": _PAIRS + "SELECT repo_id, symbol_a, symbol_b FROM f WHERE n_ab >= 6 AND n_ab * n_records >= 3 * n_a * n_b",
    "p1_lift": _PAIRS + "SELECT *, round(n_ab * n_records / (n_a::DOUBLE * n_b), 6) AS lift FROM f",
    "p5_found": """
WITH r AS (
  SELECT query_id, lower(trim(kind, ' ' || chr(9) || chr(10) || chr(13))) AS kind, score, file_path, qualified_name, result_id
  FROM batch_results WHERE kind IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, kind, qualified_name ORDER BY score DESC, file_path ASC NULLS LAST, result_id ASC NULLS LAST) = 1)
SELECT query_id, kind, rank_no::INTEGER AS rank_no, result_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, file_path ASC NULLS LAST, qualified_name ASC NULLS LAST) AS rank_no FROM b)
WHERE rank_no <= 5
""",
}
