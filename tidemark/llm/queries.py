"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, html_text, mixing, near_dups, packing, quality, secret_scan, sharding, suffix_dedup, toxicity, url_rules, vector_codes, version_sketch

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.decide(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES), ["page_id"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_sketch.compare_versions(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), by_length=True)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_books(coded, books, "vec_id")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is an owner, and each of its languages a repository
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secret_scan.summary(secret_scan.findings(docs, F.col("source"), F.struct("source", "lang")), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_toxicity, op4_best_fit_packing, op5_suffix_dedup, op6_near_duplicates, op7_document_fingerprints, op8_sharding, op9_html_extraction, op10_source_mixing, op11_conversation_trie, op12_vector_codes, op13_secret_scans)
}


def _quality_sql() -> str:
    grams = sorted({*quality.COVERAGE_LIMITS, quality.BASE_WINDOW})
    parts = [
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "wl AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)",
        "w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM wl)",
        "wc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id)",
        "li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)",
        "lw AS (SELECT doc_id, line, list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) AS chars FROM li)",
        "lg AS (SELECT doc_id, line, any_value(chars) AS chars, count(*) - 1 AS extra FROM lw WHERE chars > 0 GROUP BY doc_id, line)",
        "dl AS (SELECT doc_id, sum(extra) AS n_dup_lines, sum(extra * chars) AS dup_line_chars FROM lg GROUP BY doc_id)",
    ]
    for n in grams:
        parts += [
            f"g{n} AS (SELECT doc_id, unnest(list_transform(range(len(ws) - {n - 1}), lambda k: array_to_string(ws[k + 1:k + {n}], ' '))) AS gram, unnest(range(len(ws) - {n - 1})) AS i FROM wl WHERE len(ws) >= {n})",
            f"t{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g{n}) WHERE k > 1)",
            f"c{n} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM w SEMI JOIN (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM t{n}) USING (doc_id, i) GROUP BY doc_id)",
        ]
    columns = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in grams)
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in grams)
    parts.append(
        "m AS (SELECT d.doc_id, coalesce(wc.n_words, 0)::BIGINT AS n_words, coalesce(wc.word_chars, 0)::BIGINT AS word_chars,"
        " length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n_dup_lines, 0)::BIGINT AS n_dup_lines,"
        f" coalesce(c{quality.BASE_WINDOW}.n, 0)::BIGINT AS n_repeat_words, coalesce(dl.dup_line_chars, 0)::BIGINT AS dup_line_chars, {columns}"
        f" FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN dl USING (doc_id) {joins})"
    )
    good = [f"100 * n_symbols <= {quality.SYMBOL_LIMIT} * n_words", f"100 * dup_line_chars <= {quality.DUP_LINE_LIMIT} * word_chars"]
    good += [f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in quality.COVERAGE_LIMITS.items()]
    return ", ".join(parts) + f", f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m) SELECT *, (NOT base_failed AND {' AND '.join(good)}) AS kept FROM f"


def _url_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in URL_RULES)
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id, row_number() OVER () AS row, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, row,
  translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
m AS (SELECT h.row, arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) AS best FROM h
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.row)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (row)"""


def _mixing_sql(last: int = 20) -> str:
    """The passes one after the other; after 20 of them the bound is below one word for units of up to a million."""
    passes = ",\n".join(
        f"fit{k} AS (SELECT c.*, gap, sum(words) OVER (PARTITION BY c.source ORDER BY rank, u, size, weight ROWS UNBOUNDED PRECEDING) AS upto FROM k{k} c JOIN g{k} g ON c.source IS NOT DISTINCT FROM g.source WHERE words <= bound),\n"
        f"g{k + 1} AS MATERIALIZED (SELECT g.source, any_value(g.gap) - coalesce(max(upto) FILTER (upto <= c.gap), 0) AS gap, least(any_value(g.gap) - coalesce(max(upto) FILTER (upto <= c.gap), 0), any_value(bound) / 2) AS bound FROM g{k} g LEFT JOIN fit{k} c ON c.source IS NOT DISTINCT FROM g.source GROUP BY g.source),\n"
        f"k{k + 1} AS MATERIALIZED (SELECT k.* FROM k{k} k ANTI JOIN (FROM fit{k} WHERE upto <= gap) c ON k.source IS NOT DISTINCT FROM c.source AND k.u = c.u AND k.size = c.size AND k.weight = c.weight)"
        for k in range(last)
    )
    return rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('20240607:' || coalesce(doc_id::VARCHAR, 't:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
t1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap,
  (150 * sum(source_size) OVER ())::DOUBLE / 100 AS budget FROM z),
t2 AS (SELECT *, cap / w AS ratio,
  (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM t1),
t3 AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM t2 WHERE level <= ratio) * w, cap)) AS target FROM t2),
sw AS (SELECT s.*, source_size, target, CASE WHEN size >= 500 THEN 2.0::DOUBLE WHEN size >= 100 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s JOIN t3 ON s.source IS NOT DISTINCT FROM t3.source),
c1 AS (SELECT source, weight, any_value(target) AS target, sum(size)::BIGINT AS words FROM sw WHERE size > 0 GROUP BY source, weight),
c2 AS (SELECT *, 2 / weight AS ratio, (target - coalesce(sum(2 * words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight * words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c1),
c3 AS (SELECT source, coalesce(arg_min(level, ratio) FILTER (level <= ratio), max(ratio)) AS rate FROM c2 GROUP BY source),
e1 AS (SELECT sw.*, least(coalesce(rate, 0.0::DOUBLE) * weight, 2.0::DOUBLE) AS expected FROM sw LEFT JOIN c3 ON sw.source IS NOT DISTINCT FROM c3.source),
e2 AS (SELECT *, floor(expected)::INT AS copies, expected - floor(expected) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM e2),
r0 AS (SELECT *, target - sum(size * copies) OVER (PARTITION BY source) AS room FROM e3),
un AS (SELECT source, rank, u, size, weight, (count(*) * size)::BIGINT AS words FROM r0 WHERE rank IS NOT NULL AND size > 0 GROUP BY source, rank, u, size, weight),
g0 AS (SELECT source, any_value(room)::DOUBLE AS gap, 'infinity'::DOUBLE AS bound FROM r0 GROUP BY source), k0 AS (SELECT * FROM un),
{passes},
lb AS (SELECT k.source, arg_min(struct_pack(u := u, size := size, weight := weight), struct_pack(miss := abs(gap - words), rank := rank, u := u, size := size, weight := weight)) AS unit
  FROM k{last} k JOIN g{last} g ON k.source IS NOT DISTINCT FROM g.source WHERE words > 0 AND abs(gap - words) < gap GROUP BY k.source),
ok AS (SELECT source, u, size, weight FROM un ANTI JOIN k{last} k ON un.source IS NOT DISTINCT FROM k.source AND un.u = k.u AND un.size = k.size AND un.weight = k.weight
  UNION ALL SELECT source, unit.u, unit.size, unit.weight FROM lb)
SELECT r0.doc_id, r0.size, r0.source_size, r0.target, (r0.size * (r0.copies + (ok.u IS NOT NULL)::INT))::BIGINT AS taken, r0.copies + (ok.u IS NOT NULL)::INT AS copies
FROM r0 LEFT JOIN ok ON r0.rank IS NOT NULL AND r0.source IS NOT DISTINCT FROM ok.source AND r0.u = ok.u AND r0.size = ok.size AND r0.weight = ok.weight"""


_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(len(ws) - 3), lambda k: array_to_string(ws[k + 1:k + 4], ' ')) WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n_shingles + nb.n_shingles - k)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n_shingles"""


def _secret_sql() -> str:
    """Starts of matches are sums of what lies between them and of themselves: the pieces of a split, and the matches."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    keys = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"(?:{keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = [
        ("assign", assign, 1, f"length(value) >= {secret_scan.LEAST_ASSIGN}"),
        ("access", "AKIA[A-Z0-9]+", 0, f"length(whole) >= {secret_scan.LEAST_ACCESS}"),
        ("hex", "[0-9a-f]+", 0, f"length(whole) >= {secret_scan.LEAST_HEX}"),
        ("token", "[A-Za-z0-9+/_=-]+", 0, f"length(whole) BETWEEN {secret_scan.LEAST_TOKEN} AND {secret_scan.MOST_TOKEN}"),
    ]
    parts = ["d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source, lang FROM documents)"]
    for k, (name, pattern, group, fit) in enumerate(kinds):
        parts.append(
            f"r{k} AS (SELECT row, unnest(string_split_regex(text, '{pattern}')) AS piece, unnest(list_append(regexp_extract_all(text, '{pattern}'), NULL)) AS whole,"
            f" unnest(list_append(regexp_extract_all(text, '{pattern}', {group}), NULL)) AS value, unnest(range(len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM d)"
        )
        parts.append(
            f"s{k} AS (SELECT row, {k} AS kind, '{name}' AS name, s AS start, s + length(whole) AS stop, value FROM (SELECT *, (sum(length(piece) + coalesce(length(whole), 0)) OVER (PARTITION BY row ORDER BY i) - length(whole))::BIGINT AS s FROM r{k})"
            f" WHERE whole IS NOT NULL AND {fit})"
        )
    random = (
        f"len(list_distinct(string_split(value, ''))) >= {secret_scan.LEAST_CHARACTERS} AND len(regexp_extract_all(value, '[0-9]+')) >= {secret_scan.LEAST_DIGIT_RUNS} AND regexp_matches(value, '[^0-9]')"
    )
    parts += [
        "b AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2)",
        f"o AS (SELECT *, {random} AS random FROM (FROM b UNION ALL FROM s3 WHERE NOT EXISTS (FROM b WHERE b.row = s3.row AND b.start < s3.stop AND s3.start < b.stop)))",
        "a AS (SELECT * FROM o WHERE kind < 3 OR random)",
        "u AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) AS owners, count(DISTINCT coalesce('s' || source, '') || chr(10) || coalesce('l' || lang, '')) AS repositories FROM a JOIN d USING (row) GROUP BY value)",
        f"j AS (SELECT a.*, random AND owners <= {secret_scan.MOST_OWNERS} AND repositories <= {secret_scan.MOST_REPOSITORIES} AS live FROM a JOIN u USING (value))",
        "f AS (SELECT *, name || ':' || start || ':' || stop AS said FROM j WHERE kind < 3 OR live)",
        "g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,"
        " string_agg(said, ',' ORDER BY start, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (random AND NOT live) AS n_copied FROM f GROUP BY row)",
    ]
    counts = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied"))
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"


def _codes_sql() -> str:
    n, size = vector_codes.POSITIONS, vector_codes.ENTRIES
    parts = [
        f"k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m AS (SELECT row, p, list_slice(v, p * (len(v) // {n}) + 1, (p + 1) * (len(v) // {n})) AS part FROM k, range({n}) AS t(p))",
        f"b0 AS (SELECT p, row - 1 AS e, part FROM m WHERE row <= {size})",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        gap = "list_sum(list_transform(list_zip(m.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        parts.append(f"a{k} AS (SELECT row, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT m.row, p, b.e, {gap} AS d FROM m JOIN b{k} b USING (p)) GROUP BY row, p)")
        if k < vector_codes.ROUNDS:
            parts.append(f"u{k} AS (SELECT p, best.e AS e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, best, unnest(part) AS x, unnest(range(len(part))) AS i FROM a{k} JOIN m USING (row, p)) GROUP BY ALL)")
            parts.append(f"n{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS part FROM u{k} GROUP BY p, e)")
            parts.append(f"b{k + 1} AS (SELECT p, e, coalesce(n{k}.part, b{k}.part) AS part FROM b{k} LEFT JOIN n{k} USING (p, e))")
    last = vector_codes.ROUNDS
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})")
    parts.append(f"c AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY row)")
    return "WITH " + ", ".join(parts) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (row), h"


_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
s AS (SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1]))) AS steps FROM z),
x AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], steps), lambda c, v: CASE WHEN v >= 0 THEN
  (CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384::BIGINT) ELSE xor(c, v) >> 1 END)
  ELSE (CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) END), 4294967295::BIGINT) AS crc FROM s),
h AS (SELECT x.conv_id, crc % 9 AS h, x.conv_id - x.conv_id % 5 AS base, coalesce(z.n, 0) AS nb FROM x LEFT JOIN z ON z.conv_id = x.conv_id - x.conv_id % 5),
r AS (SELECT h.conv_id, pos AS place, role, text FROM h JOIN t ON t.conv_id = base AND pos < h
  UNION ALL SELECT h.conv_id, pos - h + least(h, nb), role, text FROM h JOIN t USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, place + 1 AS depth, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY place) AS path, strlen(text) AS bytes FROM r
  UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM z),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
b AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT path[1:g] AS path, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS g FROM b) GROUP BY 1),
l AS (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY path)
SELECT b.conv_id, b.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, b.n_convs, b.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM b JOIN u ON u.path = b.path LEFT JOIN e ON e.path = b.path LEFT JOIN n up ON b.depth > 0 AND up.path = b.path[1:b.depth - 1]"""


ORACLES: dict[str, str] = {"op11_conversation_trie": _TRIE_SQL, "op12_vector_codes": _codes_sql(), "op13_secret_scans": _secret_sql(), "op1_quality_rules": _quality_sql(), "op2_url_filter": _url_sql(), "op6_near_duplicates": _NEAR_SQL, "op10_source_mixing": _mixing_sql()}
