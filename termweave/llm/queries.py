"""The subpackage's queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import decontaminate, fill_middle, jaccard_join, license_scan, mixing, revisits, secret_scan, sp_dropout, store, token_files, topk_search, toxicity, url_rules, vector_codes

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(host, path, action)")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


#: Captures that are made of a page, a day apart.
CAPTURES = 4


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: captures of each, a third of them responses, whose tags the others repeat, weaken, change or leave out."""
    k, place = F.col("capture"), (F.floor(F.col("page_id") / 3) + F.col("capture")) % 5
    full = (F.col("page_id") + k) % 3 == 0
    tag = F.concat(F.lit('"'), F.md5(revisits.canonical_url(F.col("url"))), F.lit('"'))
    sent = F.when(full | (place == 0), tag).when(place == 1, F.concat(F.lit("W/"), tag)).when(place == 2, F.lit('"changed"'))
    since = F.when(full | (place == 3), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    ts = F.col("page_id") + 86_400 * k
    pair = lambda name, value: F.struct(F.lit(name).alias("k"), value.cast("string").alias("v"))
    headers = F.array(
        pair("Content-Length", F.when(full, F.length("html")).otherwise(0)), pair("Date", ts), pair("ETag", sent), pair("X-Cache", F.lit("HIT")),
        pair("x-cache", F.when(k % 2 == 1, F.lit("edge"))), pair("Cache-Control", F.when(~full, F.lit("max-age=60"))), pair("Content-Type", F.when(full, F.lit("text/html"))),
    )
    rows = pages.withColumn("capture", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))))
    return rows.select(
        (F.col("page_id") * CAPTURES + k).alias("record_id"), "url", ts.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, 200).otherwise(304).alias("status"), sent.alias("etag"), since.alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.map_from_entries(headers).alias("headers"),
    )


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(page_records(_table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "canonical_url", "base_record_id", "outcome", "status", F.array_join(lines, "\n").alias("headers"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sp_dropout.decode(sp_dropout.encode(docs, model, dropout=0.1, seed=17), model)
    return done.select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.expr("text <=> decoded").alias("lossless"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_tokens(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, keep=("doc_id",))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1, percent=90, spm_percent=20)
    digest = lambda c: F.sha2(c, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256, keep=("vec_id", "label"))
    found = vector_codes.label_errors(store.materialize(coded, "coded"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def queries() -> dict:
    found = (
        op1_url_filter, op2_revisits, op3_secrets, op4_decontaminate, op5_jaccard, op6_sentencepiece, op7_topk, op8_licenses, op9_token_files, op10_toxicity,
        op11_mixing, op12_fill_middle, op13_vector_codes,
    )
    return {f.__name__: f for f in found}


_URL_CASES = """
  CASE WHEN under_net_en THEN 'example.net/en/' WHEN under_com_de THEN 'example.com/de/' WHEN under_org_fr THEN 'org/fr/' WHEN under_net THEN 'net/' END"""


def _mixing_sql() -> str:
    """Targets by trial of every possible set of full sources, copies by the sum at each document, tier after tier."""
    bits = "('0x' || substr(md5('11/' || coalesce(source, '')), 1, 8))"
    tiers, last = "", "t0"
    for t, (low, high) in enumerate(((0, 1), (1, 2), (2, 3))):
        rest, over = f"(source_size - w{low})", f"(num - den * {' - den * '.join(['0', *(f'r{i}' for i in range(1, t + 1))])})"
        offset = f"CAST({bits} AS BIGINT) * down0 // 4294967296" if t == 0 else f"((up{t - 1} * (n{t} - n{t - 1}) + offset{t - 1}) % down{t - 1}) * down{t} // down{t - 1}"
        copies = f"((i - n{low} + 1) * up{t} + offset{t}) // down{t} - ((i - n{low}) * up{t} + offset{t}) // down{t}"
        tiers += f"""
a{t} AS (SELECT *, CAST(CASE WHEN {rest} <= 0 OR {over} <= 0 THEN 0 WHEN {over} >= 3 * den * {rest} THEN 3 ELSE {over} END AS HUGEINT) AS up{t}, CAST(CASE WHEN {rest} <= 0 OR {over} <= 0 OR {over} >= 3 * den * {rest} THEN 1 ELSE den * {rest} END AS HUGEINT) AS down{t} FROM {last}),
b{t} AS (SELECT *, CAST({offset} AS HUGEINT) AS offset{t} FROM a{t}),
c{t} AS (SELECT doc_id, source, size, CAST({copies} AS BIGINT) AS copies FROM o JOIN b{t} USING (source) WHERE i >= n{low} AND i < n{high}),
t{t + 1} AS (SELECT b{t}.*, coalesce(r, 0) AS r{t + 1} FROM b{t} LEFT JOIN (SELECT source, CAST(sum(size * copies) AS HUGEINT) AS r FROM c{t} GROUP BY source) USING (source)),"""
        last = f"t{t + 1}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1114111)) AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size DESC, md5('11:' || doc_id) NULLS FIRST) - 1 AS HUGEINT) AS i, sum(size) OVER (PARTITION BY source ORDER BY length(bin(size)) DESC) AS upto, sum(size) OVER (PARTITION BY source) AS whole FROM d),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, 0 AS n0, count(*) FILTER (upto * 8 <= whole * 4) AS n1, count(*) FILTER (upto * 8 <= whole * 7) AS n2, count(*) AS n3,
        0 AS w0, coalesce(sum(size) FILTER (upto * 8 <= whole * 4), 0) AS w1, coalesce(sum(size) FILTER (upto * 8 <= whole * 7), 0) AS w2 FROM o GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source) - 1) % 3 + 1] AS weight FROM s),
v AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
k AS (SELECT l, (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (ratio <= l), 0) FROM v) AS shared, (SELECT sum(weight) FILTER (ratio > l) FROM v) AS open, (SELECT min(ratio) FILTER (ratio > l) FROM v) AS next FROM (SELECT -1.0 AS l UNION SELECT ratio FROM v)),
g AS (SELECT * FROM k WHERE open IS NULL OR shared / open <= next ORDER BY l LIMIT 1),
t0 AS (SELECT v.*, CAST(CASE WHEN ratio <= l THEN 3 * source_size ELSE shared * weight END AS HUGEINT) AS num, CAST(CASE WHEN ratio <= l THEN 1 ELSE open END AS HUGEINT) AS den FROM v CROSS JOIN g),{tiers}
every AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS target, size * copies AS taken FROM every JOIN t0 USING (source)"""


def _codes_sql() -> str:
    """Two rounds of assignment to 64 entries a part, each from all rows."""
    near = lambda book: f"SELECT vec_id, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.p, k, CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v JOIN {book} b USING (p)) GROUP BY ALL"
    moved = lambda book, by: (
        f"SELECT p, k, coalesce(list(CAST(floor(s / n) AS BIGINT) ORDER BY pos), any_value(b.x)) AS x FROM {book} b LEFT JOIN (SELECT p, k, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT {by}.p, {by}.k, v.x, unnest(range(1, len(v.x) + 1)) AS pos FROM {by} JOIN v USING (vec_id, p)) GROUP BY ALL) USING (p, k) GROUP BY p, k"
    )
    return f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS x FROM (SELECT *, unnest(range(16)) AS p FROM q)),
b0 AS (SELECT v.p, k, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM q ORDER BY vec_id LIMIT 64) USING (vec_id)),
n0 AS MATERIALIZED ({near("b0")}), b1 AS MATERIALIZED ({moved("b0", "n0")}),
n1 AS MATERIALIZED ({near("b1")}), b2 AS MATERIALIZED ({moved("b1", "n1")}),
n2 AS MATERIALIZED ({near("b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY vec_id),
e AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN q USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256 FROM c JOIN q USING (vec_id) JOIN e ON q.label IS NOT DISTINCT FROM e.label"""


def oracle_sql() -> dict[str, str]:
    mask = lambda m, at: ", ".join(f"w[{at} + {i + 1}]" for i, bit in enumerate(m) if bit == "1")
    seeds = lambda src, key: " UNION ALL ".join(f"SELECT {key}, p, '{m}' AS mask, {len(m)} AS span, [{mask(m, 'p')}] AS seed FROM (SELECT *, unnest(range(0, n - {len(m)} + 1)) AS p FROM {src} WHERE n >= {len(m)})" for m in decontaminate.MASKS)
    equal = lambda start: " + ".join(f"CASE WHEN {k} < wide AND off + {start} + {k} >= 0 AND d.w[off + {start} + {k + 1}] = i.w[{start} + {k + 1}] THEN 1 ELSE 0 END" for k in range(13))
    canonical = r"regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return {
        "op1_url_filter": rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (
  SELECT *, ends_with('.' || host, '.net') AND starts_with(path, '/') AS under_net, ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') AS under_net_en,
         ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') AS under_com_de, ends_with('.' || host, '.org') AND starts_with(path, '/fr/') AS under_org_fr FROM parts)
SELECT page_id, host, path, {_URL_CASES} AS rule,
  CASE WHEN under_net_en THEN 'allow' WHEN under_com_de THEN 'block' WHEN under_org_fr THEN 'allow' WHEN under_net THEN 'block' ELSE 'allow' END AS verdict FROM fits""",
        "op2_revisits": rf"""
WITH r AS (SELECT page_id, html, lower(url) LIKE 'https://%' AS safe, {canonical} AS rest FROM pages),
h AS (SELECT *, lower(regexp_extract(rest, '^[^/?]*')) AS host FROM r),
c AS (
  SELECT page_id, length(html) AS size,
    regexp_replace(regexp_replace(host, CASE WHEN safe THEN ':443$' ELSE ':80$' END, ''), '^www\.', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS kept FROM h),
p AS (SELECT page_id, size, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS curl FROM c),
k AS (SELECT *, page_id * {CAPTURES} + capture AS id, page_id + 86400 * capture AS ts, (page_id // 3 + capture) % 5 AS place, (page_id + capture) % 3 = 0 AS whole FROM (SELECT *, unnest(range({CAPTURES})) AS capture FROM p)),
t AS (SELECT *, (ts, id) AS t, CASE WHEN whole OR place IN (0, 1) THEN md5(curl) WHEN place = 2 THEN 'changed' END AS tag, CASE WHEN whole OR place = 3 THEN page_id END AS since FROM k),
f AS (SELECT * FROM t WHERE whole),
m AS (
  SELECT t.id, t.ts, t.curl, t.capture, t.place, f.id AS base_id, f.size, f.curl AS base_curl, coalesce(t.tag = f.tag, t.since = f.since) AS agree
  FROM t ASOF LEFT JOIN f ON t.curl = f.curl AND t.t > f.t WHERE NOT t.whole)
SELECT id AS record_id, curl AS canonical_url, CASE WHEN agree THEN base_id END AS base_record_id,
  CASE WHEN base_id IS NULL THEN 'orphan' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS outcome, CASE WHEN agree THEN 200 END AS status,
  CASE WHEN agree THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: '
    || CASE WHEN place = 1 THEN 'W/' ELSE '' END || '"' || md5(base_curl) || '"' || chr(10) || 'x-cache: HIT' || CASE WHEN capture % 2 = 1 THEN ', edge' ELSE '' END END AS headers
FROM m""",
        "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)),
i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)),
ds AS ({seeds("d", "doc_id")}), si AS ({seeds("i", "item_id")}),
h AS (SELECT DISTINCT doc_id, item_id, ds.p AS p, si.p AS j, si.span AS span FROM ds JOIN si USING (mask, seed)),
s AS (SELECT h.doc_id, h.item_id, h.p, h.p - h.j AS off, least(13, i.n) AS wide, unnest(range(greatest(0, h.j + h.span - least(13, i.n)), least(h.j, i.n - least(13, i.n)) + 1)) AS start FROM h JOIN i USING (item_id)),
short AS (SELECT d.doc_id, i.item_id, d.p, d.p AS off, i.n AS wide, 0 AS start FROM (SELECT *, unnest(range(n)) AS p FROM d) d JOIN (SELECT * FROM i WHERE n BETWEEN {decontaminate.FEWEST} AND 13) i ON d.p + i.n <= d.n),
v AS (SELECT doc_id, item_id, p, wide, {equal("start")} AS best FROM (SELECT * FROM s UNION ALL SELECT * FROM short) JOIN d USING (doc_id) JOIN i USING (item_id))
SELECT doc_id, item_id, CAST(max(best) AS INTEGER) AS best, CAST(max(wide) AS INTEGER) AS "of", CAST(min(p) AS INTEGER) AS first_word FROM v WHERE best + 1e-9 >= 0.8 * wide GROUP BY doc_id, item_id""",
        "op5_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least AS component_id FROM (SELECT doc_id, min(root) AS least FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
        "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op11_mixing": _mixing_sql(),
        "op12_fill_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
        "op13_vector_codes": _codes_sql(),
    }
