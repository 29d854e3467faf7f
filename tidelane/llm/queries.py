"""Queries opN_<name>: each operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from .common import table


def _path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark, sf_dir):
    from .shingle_join import join

    return join(table(spark, sf_dir, "documents"), width=4, percent=85).drop("set_id")


def op2_quality_rules(spark, sf_dir):
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _path(), 512)


def op5_harmonic_packing(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _path(), 2048, 1)


def op6_decontamination(spark, sf_dir):
    from .decontamination import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, percent=80)


def op7_pii(spark, sf_dir):
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), 400)


def op9_warc(spark, sf_dir):
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), 0)


def op10_quality_classifier(spark, sf_dir):
    from .quality_classifier import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark, sf_dir):
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_tokenizer_alignment(spark, sf_dir):
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), _path(), _path("piece_bpe_32k.model"))


def op13_language_model(spark, sf_dir):
    from pyspark.sql import functions as F

    from .language_model import in_seventh, language_model

    return language_model(table(spark, sf_dir, "documents"), in_seventh(F.col("doc_id")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _shingles(table: str, key: str, width: int) -> str:
    """SQL of a table's distinct shingles (key, g): A-Z lowered, words between ASCII blanks."""
    words = rf"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    runs = f"list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i:i + {width - 1}], ' '))"
    return f"SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')] ELSE {runs} END) AS g FROM (SELECT {key}, {words} AS ws FROM {table})"


OP1 = f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id", 4)}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

OP6 = f"""
WITH d AS MATERIALIZED ({_shingles("documents", "doc_id", 5)}),
i AS MATERIALIZED ({_shingles("benchmark", "item_id", 5)}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, c AS n_common FROM c JOIN n USING (item_id) WHERE 100 * c >= 80 * n
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((list_sum(list_transform(range(0, 5), lambda j: (strpos('0123456789abcdef', substr(h, (1 + 5 * k + j)::INT, 1)) - 1) * (16 ** (4 - j))::BIGINT))::BIGINT >> b) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


OP11 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails FROM w LEFT JOIN g USING (doc_id)),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, e.k, f.k] AS p FROM l a JOIN l b ON b.k <> a.k JOIN l c ON c.k NOT IN (a.k, b.k) JOIN l e ON e.k NOT IN (a.k, b.k, c.k) JOIN l f ON f.k NOT IN (a.k, b.k, c.k, e.k)),
x AS (SELECT part, good, toxic, fails, p, list_position(list_transform(p, lambda i: fails[i]), true) AS gone FROM d, o),
s AS (SELECT part, p, k, p[k] AS i, count(*) FILTER (gone IS NULL OR gone > k) AS kept, count(*) FILTER (gone = k) AS removed, count(*) FILTER (fails[p[k]] AND gone < k) AS redundant,
  count(*) FILTER (fails[p[k]] AND len(list_filter(fails, lambda z: z)) = 1) AS unique_fails, count(*) FILTER (gone = k AND good) AS good_lost, count(*) FILTER (gone = k AND toxic) AS toxic_lost
  FROM x, l GROUP BY part, p, k)
SELECT part, array_to_string(list_transform(p, lambda j: 'ABCDE'[j:j]), '') AS filter_order, k AS step, 'ABCDE'[i:i] AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11, "op1_ngram_jaccard_join": OP1, "op6_decontamination": OP6, "op9_warc": OP9}
