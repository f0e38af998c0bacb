"""The registered queries of these operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwork.session import fresh_path, materialise, tune

from . import (codebooks, licenses, line_dedup, packing, prefix_tree, quality, sentence_pieces, simhash, substring_dedup, token_counts,
               token_files, topk, warc)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keys AS (SELECT *, {SQL_LOWER.format(f"trim(line, {SQL_BLANKS})")} AS key FROM lines),
frequent AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keys LEFT JOIN frequent f ON f.key = keys.key GROUP BY doc_id""")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", *token_counts.OUTPUTS)


@query("op7_token_files")
def op7(spark, sf_dir):
    folder = fresh_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_packing")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.piece_digests(packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2))


@query("op10_warc")
def op10(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.resolved(warc.read_archives(warc.write_archives(pages, folder)))


QUALITY_RULES = {r: f"CASE WHEN {d} > 0 THEN least({quality.GRID}, {quality.GRID} * {n} // {d}) ELSE 0 END"
                 for r, (n, d) in quality.RULES.items()}


@query("op2_quality_rules", f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {SQL_BLANKS}) <> '') AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS g
  FROM words WHERE len(w) >= 3),
twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS c FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, (length(t) - length(translate(t, '{quality.CAPITALS}', '')))::BIGINT AS n_capitals,
         (length(t) - length(translate(t, '{quality.MARKS}', '')))::BIGINT AS n_marks
  FROM words LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
levels AS (SELECT doc_id, lang, base_failed, greatest({", ".join(QUALITY_RULES.values())}) AS level FROM b),
held AS (SELECT lang, level, quality FROM levels JOIN labels USING (doc_id) WHERE NOT base_failed),
sizes AS (
  SELECT lang, n FROM (SELECT lang, count(*) FILTER (WHERE quality = 1) AS n FROM held GROUP BY lang)
  WHERE pow(1 - {quality.ALPHA}::DOUBLE, n) <= {quality.DELTA}),
cuts AS (
  SELECT lang, n, cut, count(*) FILTER (WHERE quality = 1 AND level >= cut) AS lost,
         count(*) FILTER (WHERE quality = 0 AND level >= cut) AS caught
  FROM held JOIN sizes USING (lang), range(1, {quality.GRID + 1}) r(cut) GROUP BY lang, n, cut),
tested AS (
  SELECT *, caught - {quality.LOSS_WEIGHT} * lost AS gain,
         lost <= n * a AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(
           lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a))))
         <= {quality.DELTA} * n / (SELECT sum(n) FROM sizes) AS sure
  FROM (SELECT *, {quality.ALPHA}::DOUBLE AS a FROM cuts)),
fails AS (SELECT lang, coalesce(max(cut) FILTER (WHERE NOT sure), 0) AS f FROM tested GROUP BY lang),
chosen AS (
  SELECT lang, max(cut) AS cut FROM (
    SELECT lang, cut, gain, max(gain) OVER (PARTITION BY lang) AS top
    FROM tested JOIN fails USING (lang) WHERE cut > f AND gain > 0) WHERE gain = top
  GROUP BY lang),
rejected AS (SELECT DISTINCT doc_id FROM levels JOIN chosen USING (lang) WHERE level >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM b""")
def op2(spark, sf_dir):
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
                                        table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_hex("fingerprint").alias("fingerprint"), "component_id")


@query("op8_substring_dedup", """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p,
         unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' '))) AS g
  FROM words WHERE len(w) >= 20),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM later),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM flat ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.remove_repeats(docs, length=20, join_words=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_exact_topk", """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
         row_number() OVER (PARTITION BY a.r ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")
def op3(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_sentence_pieces")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model")).select(
        "doc_id", "n_pieces", "ids_crc32", "round_trip")


def _codebook_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd rounds over (part, row) pairs; each round rescans all entries."""
    steps = [f"""
kept AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, p, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] AS v
  FROM kept, range({parts}) t(p)),
book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(a.v, b.v)])::BIGINT, e := b.e)) AS n
  FROM parts a JOIN book{k} b USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
moved{k} AS (
  SELECT p, e, list(c ORDER BY i) AS v FROM (
    SELECT p, n.e AS e, i, (sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS c
    FROM near{k} JOIN parts USING (r, p), (SELECT unnest(range(1, len(q) // {parts} + 1)) AS i FROM kept WHERE r = 1)
    GROUP BY p, n.e, i) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT r, string_agg(format('{{:02x}}', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM near{rounds} GROUP BY r),
hashed AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN coded USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN coded USING (r) JOIN totals t ON kept.label IS NOT DISTINCT FROM t.label CROSS JOIN hashed"""


@query("op11_vector_codes", _codebook_sql())
def op11(spark, sf_dir):
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"),
                                      parts=16, entries=64, rounds=2, scale=256)
    # Vectors stay behind before the labels' errors join.
    narrow = materialise(coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector-codes")
    return codebooks.with_group_error(narrow, "label", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@query("op12_prefix_trie", """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, d) AS w FROM (
    SELECT conv_id, turn, left(sha256(length(role)::VARCHAR || ':' || role || text), 32) AS d, length(text) AS n FROM t) GROUP BY conv_id),
h AS (
  SELECT conv_id, w, (xor(list_reduce([4294967295::UBIGINT] || [ord(c)::UBIGINT FOR c IN string_split(conv_id::VARCHAR, '')],
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: xor(x // 2, 3988292384::UBIGINT * (x % 2)))),
    4294967295::UBIGINT) % 6)::BIGINT AS h FROM own),
c AS (
  SELECT h.conv_id, coalesce(b.w[1:h], []) || h.w[h + 1:] AS w
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
k AS (SELECT conv_id, [x.d FOR x IN w] AS d, [x.n FOR x IN w] AS n FROM c),
p AS (SELECT conv_id, unnest(range(0, len(d) + 1)) AS depth, d, n FROM k),
m AS (SELECT conv_id, depth, array_to_string(d[1:depth], ' ') AS key, array_to_string(d[1:depth - 1], ' ') AS up,
             CASE WHEN depth = 0 THEN 0 ELSE n[depth] END AS chars, len(d) = depth AS ends FROM p),
node AS (
  SELECT key, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY key, depth),
kids AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up, depth),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key, depth)),
anc AS (
  SELECT unnest(range(0, depth + 1)) AS up_depth, key, (n_convs - 1) * chars AS s, (n_children = 0)::BIGINT AS leaf FROM full_node),
sub AS (
  SELECT left(key, greatest(33 * up_depth - 1, 0)) AS key, up_depth AS depth, sum(s) AS saved, sum(leaf) AS leaves FROM anc GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, CASE WHEN a.depth > 0 THEN b.conv_id END AS parent_conv_id, a.n_convs::BIGINT AS n_convs,
       a.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM full_node a JOIN sub USING (key, depth) LEFT JOIN node b ON b.key = a.up AND b.depth = a.depth - 1""")
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sequences = prefix_tree.with_shared_heads(prefix_tree.turn_sequences(turns), every=100, modulus=6)
    return prefix_tree.prefix_tree(sequences)


def _license_sql() -> str:
    def values(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {values(licenses.template_words(text))} AS run" for label, text in licenses.PHRASES.items())
    templates = " UNION ALL ".join(
        f"SELECT '{t['label']}' AS label, {values(t['words'])} AS words, {t['need']} AS need, {t['reach']} AS reach"
        for t in licenses.prepared(licenses.TEMPLATES, licenses.THRESHOLD))
    return f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({SQL_LOWER.format("coalesce(text, '')")},
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
phrases AS ({phrases}), templates AS ({templates}),
places AS (
  SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(run)] = run)) AS place
  FROM words, phrases WHERE len(list_intersect(w, run)) = len(run)),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_distinct(list(label)) AS base FROM places GROUP BY r),
likely AS (SELECT r, w FROM words, (SELECT list_distinct(flatten(list(words))) AS v FROM templates) WHERE len(list_intersect(w, v)) >= (SELECT min(need) FROM templates)),
blocks AS (
  SELECT r, reach, list_distinct(w[k * reach + 1:(k + 2) * reach]) AS b
  FROM likely, (SELECT DISTINCT reach FROM templates), unnest(range(0, greatest((len(w) + reach - 1) // reach - 1, 1))) t(k)),
met AS (
  SELECT r, label, len(list_intersect(words, b)) AS hits, len(words) AS size, need FROM blocks JOIN templates USING (reach)),
found AS (SELECT r, list_distinct(list(label)) AS labels, max(hits::DOUBLE / size) AS best FROM met WHERE hits >= need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(labels, []))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


@query("op13_license_scans", _license_sql())
def op13(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
