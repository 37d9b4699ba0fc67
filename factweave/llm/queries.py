"""The queries of the corpus operators: each applies one operator to its whole table.

Imports stand inside the functions, so that a task that needs one operator loads no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.common import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.exact_dedup import dedup_exact

    return dedup_exact(spark, f"{sf_dir}/documents.parquet")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), window=100).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), distance=3)


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.superkmer_dedup import dedup_word_windows

    return dedup_word_windows(table(spark, sf_dir, "documents"), window=20).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"), keep=False)


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from factweave.llm.common import scratch
    from factweave.llm.token_files import read_digests, write_tokens

    path = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    write_tokens(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factweave.llm.line_dedup import dedup_lines

    cut = dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.secret_scan import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factweave.llm.hard_negatives import mine

    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_suffix_dedup, op3_simhash, op4_superkmer_dedup, op5_decontamination,
    op6_mixing, op7_token_files, op8_quality, op9_line_dedup, op10_toxicity,
    op11_secret_scan, op12_hard_negatives, op13_vector_codes,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _secret_sql() -> str:
    """Matches and the pieces before them, rule by rule; their lengths added up are the places."""
    from factweave.llm.secret_scan import BASE, RULES

    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    per_rule = lambda n, r: (
        f"SELECT r, {n} AS nth, '{r.kind}' AS kind, unnest(m) AS hit, unnest(p[1:len(m)]) AS piece, generate_subscripts(m, 1) AS i FROM"
        f" (SELECT r, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_split_to_array(t, {quoted(r.pattern)}) AS p FROM d WHERE regexp_matches(t, {quoted(r.pattern)}))"
    )
    first = BASE[0]
    rules = "\nUNION ALL ".join(per_rule(n, r) for n, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
hit AS ({rules}),
placed AS (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY r, nth ORDER BY i) AS hi FROM hit),
span AS (SELECT r, nth, kind, hi - length(hit) AS lo, kind || ':' || (hi - length(hit)) || ':' || hi AS s FROM placed
  WHERE kind <> '{first.kind}' OR length(regexp_extract(hit, {quoted(first.pattern)}, {first.group})) >= {first.least}),
per AS (SELECT r, {sums}, string_agg(s, ',' ORDER BY lo, nth) FILTER (kind IN ({base})) AS base, string_agg(s, ',' ORDER BY lo, nth) AS spans FROM span GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per ON per.r = d.r"""


_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """A CTE for each assignment (a) and each codebook (c); products of whole doubles are exact."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, s, min(d) AS d, arg_min(e, struct_pack(d := d, e := e)) AS e FROM (
  SELECT r, seg.p, seg.s, e, list_inner_product(seg.s, seg.s) - 2 * list_inner_product(seg.s, c{k}.s) + list_inner_product(c{k}.s, c{k}.s) AS d FROM seg JOIN c{k} ON c{k}.p = seg.p) GROUP BY r, p, s)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, e, list(((t - ((t % n) + n) % n) // n)::DOUBLE ORDER BY i) AS s FROM (
  SELECT p, e, i, sum(x::HUGEINT) AS t, count(*) AS n FROM (SELECT p, e, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.s, c{k}.s) AS s FROM c{k} LEFT JOIN m{k} ON m{k}.p = c{k}.p AND m{k}.e = c{k}.e)")
    steps = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [floor(4096 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE}),
seg AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS s FROM v, range({parts}) AS u(p)),
c0 AS (SELECT p, r AS e, s FROM seg WHERE r < {entries}),
{steps},
per AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN s], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM per JOIN v ON v.r = per.r CROSS JOIN book"""


ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, c.r AS cr, c.vec_id AS id, c.label, list_inner_product(a.v, c.v)::BIGINT AS score FROM v AS a JOIN v AS c ON c.r <> a.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS n FROM s WHERE label = al QUALIFY n <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND s.label <> p.al AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10""",
    "op13_vector_codes": _codes_sql(),
    "op11_secret_scan": _secret_sql(),
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)""",
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p:p + 99] AS s FROM d, unnest(range(1, octet_length(b) - 98)) AS u(p) WHERE octet_length(b) >= 100),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(CASE WHEN p <= q + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM dup)) GROUP BY doc_id, run),
piece AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS a, lo AS z FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT piece.doc_id, unhex(string_agg(hex(b[a:coalesce(z - 1, octet_length(b))]), '' ORDER BY a)) AS k FROM piece JOIN d ON d.doc_id = piece.doc_id GROUP BY piece.doc_id),
total AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op4_superkmer_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(p) WHERE len(w) >= 20),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM win) WHERE n > 1),
word AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
flag AS (SELECT word.doc_id, i, word, max(dup.p) OVER (PARTITION BY word.doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
         FROM word LEFT JOIN dup ON dup.doc_id = word.doc_id AND dup.p = word.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM flag GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark WHERE item_id IS NOT NULL),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + 9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item),
win AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(p) WHERE len(w) >= n),
hit AS (SELECT win.doc_id, win.p, win.n, item.item_id FROM win JOIN item ON item.n = win.n AND item.s = win.s),
spots AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS k FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id""",
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) x),
s AS (SELECT doc_id, i, t, row_number() OVER w AS p, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3 FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, p, 1 AS n, t AS run FROM s UNION ALL SELECT doc_id, p, 2, t || chr(10) || t1 FROM s
  UNION ALL SELECT doc_id, p, 3, t || chr(10) || t1 || chr(10) || t2 FROM s UNION ALL SELECT doc_id, p, 4, t || chr(10) || t1 || chr(10) || t2 || chr(10) || t3 FROM s),
f AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS repeated FROM r WHERE n = 4 AND run IS NOT NULL OR strlen(run) - n + 1 >= 240),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM f WHERE repeated),
k AS (SELECT l.doc_id, l.i, l.line, l.t, g.p IS NOT NULL AS gone FROM l LEFT JOIN s USING (doc_id, i) LEFT JOIN g ON g.doc_id = s.doc_id AND g.p = s.p)
SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id""",
}
