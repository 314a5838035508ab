"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, fill_middle, hilbert_shards, mixing, nndescent, orc_tokens, packing, prefix_trie, shared, simhash, suffix_dedup, topk_kdtree, toxicity, url_templates
from .shared import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return topk_kdtree.top_k(vectors, asked, k=5)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return nndescent.nearest(vectors, asked, k=20)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), length=400, words=51)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 for instruction data: conversations, whose first turns bear no loss, under limits of tokens, segments and loss-bearing tokens."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.coalesce(t["text"], F.lit("")))
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("_turns"))
    docs = whole.select("doc_id", F.array_join("_turns", "\n").alias("text"), F.get("_turns", F.lit(0)).alias("prompt"))
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), segments=16, loss=1536, prompt="prompt")
    return packing.digest(pieces, "loss")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "orc")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return orc_tokens.layout(spark, path)


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared.new_path(spark, "shards")
    hilbert_shards.write(docs, path, ["lang", "source", "n_chars", "doc_id"], shards=8, law="bytes")
    return hilbert_shards.digest(hilbert_shards.read(spark, path, docs.schema), law="bytes")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie.lending_trie(table(spark, sf_dir, "conversations"), heads, F.col("conv_id") - F.col("conv_id") % 20, most_heads=3)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transformed(table(spark, sf_dir, "documents"), kind="lines", seed=7, rate=100, spm=50))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name == "instruction_packing"}


#: The other operators go beyond SQL (tokenizers, XXH64, learned machines, graph search, shuffles by hash); tests compare them with brute force.
SQL = {
    "op4_suffix_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n,
   list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS l FROM documents),
  w AS (SELECT r, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, n - 399))) AS i FROM d)),
  s AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
  g AS (SELECT r, min(i) AS b, max(i) + 400 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s) GROUP BY r, g),
  p AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS f FROM g),
  k AS (SELECT p.r, sum(e - b) AS removed, count(*) AS spans, string_agg(substr(h, 2 * f + 1, 2 * (b - f)), '' ORDER BY b) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM p JOIN d USING (r) GROUP BY p.r),
  v AS (SELECT r, i, hash(l[i + 1 : i + 51]) AS k FROM (SELECT r, l, unnest(range(0, greatest(0, len(l) - 50))) AS i FROM d)),
  x AS (SELECT r, i, least(51, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 51)) AS c FROM v SEMI JOIN (SELECT k FROM v GROUP BY k HAVING count(*) > 1) USING (k)),
  y AS (SELECT r, sum(c) AS words FROM x GROUP BY r)
 SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(words, 0)::BIGINT AS n_words_removed
  FROM d LEFT JOIN k USING (r) LEFT JOIN y USING (r)""",
    "op5_url_filter": r"""WITH u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  h AS (SELECT page_id, coalesce(host, '') AS host, path FROM u),
  rules(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
  p AS (SELECT DISTINCT host, path FROM h),
  m AS (SELECT host, path, max_by(rh || rp, (length(rh) + length(rp), rh, rp)) AS rule, max_by(rv, (length(rh) + length(rp), rh, rp)) AS rv FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
  c AS (SELECT host, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^(\d[\d._-]*|[0-9a-fA-F]{8,})(\.[A-Za-z]{1,5})?$')
    OR (regexp_matches(s, '^[A-Za-z0-9_-]{12,}(\.[A-Za-z]{1,5})?$') AND regexp_matches(s, '\d')) THEN '*' || regexp_extract(s, '(\.[A-Za-z]{1,5})$', 1) ELSE s END) AS form,
    path, count(*) AS n, count(rv) AS known, count(*) FILTER (WHERE rv = 'block') AS bad FROM h LEFT JOIN m USING (host, path) GROUP BY host, path),
  f AS (SELECT host, form, sum(n) AS n, sum(known) AS known, sum(bad) AS bad FROM c GROUP BY host, form),
  t AS (SELECT host, form, unnest(range(1, len(form) + 1)) AS i, n, known, bad FROM f),
  b AS (SELECT host, form[1:i] AS node, form[1:i - 1] AS parent, form[i] AS seg, sum(n) AS n, sum(known) AS known, sum(bad) AS bad FROM t GROUP BY ALL),
  a AS (SELECT host, parent, sum(n) AS an, sum(known) AS ak, sum(bad) AS ab, count(*) AS kids FROM b GROUP BY host, parent),
  e AS (SELECT *, kids > 16 AND n < 0.02 * an AND NOT (known > 0 AND ak > known AND ab > 0 AND ab < ak AND abs(bad / nullif(known, 0) - (ab - bad) / nullif(ak - known, 0)) >= 2 * sqrt(ab / ak * (1 - ab / ak) * (1 / nullif(known, 0) + 1 / nullif(ak - known, 0)))) AS rare0,
    CASE WHEN known > 0 THEN floor(asin(sqrt(least(1.0, (bad + 4 * ((ab + 2) / (ak + 4))) / (known + 4)))) / (0.5 / sqrt(ak / kids + 4))) END AS kind FROM b JOIN a USING (host, parent)),
  o AS (SELECT *, coalesce(rare0, false) AS rare FROM e),
  q AS (SELECT host, parent, kind, min(seg) AS first FROM o WHERE NOT rare AND kind IS NOT NULL GROUP BY ALL),
  l AS (SELECT o.host, node, CASE WHEN rare THEN '*' ELSE coalesce(first, seg) END AS merged FROM o LEFT JOIN q ON o.host = q.host AND o.parent = q.parent AND o.kind = q.kind),
  z AS (SELECT t.host, t.form, string_agg('/' || merged, '' ORDER BY i) AS merged FROM t JOIN l ON t.host = l.host AND t.form[1:i] = l.node GROUP BY t.host, t.form),
  y AS (SELECT f.host, f.form, coalesce(merged, '') AS merged, known, bad FROM f LEFT JOIN z ON f.host = z.host AND f.form = z.form),
  j AS (SELECT host, merged, known, (bad + 4 * (hb + 2) / (hk + 4)) / (known + 4) AS purity FROM (SELECT host, merged, sum(known) AS known, sum(bad) AS bad FROM y GROUP BY ALL) JOIN (SELECT host, sum(known) AS hk, sum(bad) AS hb FROM y GROUP BY host) USING (host))
 SELECT page_id, h.host, h.path, rule, coalesce(rv, CASE WHEN j.known > 0 AND purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict
  FROM h JOIN c ON h.host = c.host AND h.path = c.path JOIN y ON y.host = c.host AND y.form = c.form JOIN j ON j.host = y.host AND j.merged = y.merged LEFT JOIN m ON m.host = h.host AND m.path = h.path""",
    "op1_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_hilbert_shards": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lang, source, n_chars FROM documents),
 e AS (SELECT hex(encode(min(lang))) AS l1, hex(encode(max(lang))) AS h1, hex(encode(min(source))) AS l2, hex(encode(max(source))) AS h2, count(*) AS n FROM d),
 f AS (SELECT n, (SELECT count(*) FROM range(1, 1 + least(len(l1), len(h1)) // 2) v(i) WHERE l1[1:2 * i] = h1[1:2 * i]) AS p1, (SELECT count(*) FROM range(1, 1 + least(len(l2), len(h2)) // 2) v(i) WHERE l2[1:2 * i] = h2[1:2 * i]) AS p2 FROM e),
 q AS (SELECT r, 0 AS k, ('0x' || rpad(substr(hex(encode(lang)), 2 * p1 + 1, 12), 12, '0'))::BIGINT::DOUBLE AS v FROM d, f
  UNION ALL SELECT r, 1, ('0x' || rpad(substr(hex(encode(source)), 2 * p2 + 1, 12), 12, '0'))::BIGINT::DOUBLE FROM d, f UNION ALL SELECT r, 2, n_chars::DOUBLE FROM d UNION ALL SELECT r, 3, doc_id::DOUBLE FROM d),
 w AS (SELECT k, min(v) AS lo, max(v) AS hi FROM q GROUP BY k),
 b AS (SELECT r, k, CASE WHEN v IS NULL THEN 0 WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 4096)::BIGINT, 4095) + 1 ELSE 1 END AS bin FROM q JOIN w USING (k)),
 c AS (SELECT k, bin, floor((sum(m) OVER (PARTITION BY k ORDER BY bin) - m + m / 2) * 32 / n)::BIGINT AS cell FROM (SELECT k, bin, count(*) AS m FROM b GROUP BY k, bin), f),
 x(r, s, x) AS (SELECT r, 0, list(cell ORDER BY k) FROM b JOIN c USING (k, bin) GROUP BY r UNION ALL
  SELECT r, s + 1, list_transform(range(4), lambda j: CASE WHEN j = 0 THEN xor(x[1], CASE WHEN x[i] & q <> 0 THEN q - 1 ELSE xor(x[1], x[i]) & (q - 1) END)
   WHEN j + 1 = i AND x[i] & q = 0 THEN xor(x[i], xor(x[1], x[i]) & (q - 1)) ELSE x[j + 1] END) FROM (SELECT *, s % 4 + 1 AS i, 1::BIGINT << (4 - s // 4)::INT AS q FROM x WHERE s < 16)),
 g AS (SELECT r, [x[1], xor(x[1], x[2]), xor(xor(x[1], x[2]), x[3]), xor(xor(xor(x[1], x[2]), x[3]), x[4])] AS g FROM x WHERE s = 16),
 o AS (SELECT r, list_sum(list_transform(range(20), lambda z: ((xor(g[z % 4 + 1], u) >> (z // 4)::INT) & 1) << (z - z % 4 + 3 - z % 4)::INT)) AS place
  FROM (SELECT *, list_reduce(list_transform(range(5), lambda z: CASE WHEN g[4] & (1::BIGINT << z::INT) <> 0 THEN (1::BIGINT << z::INT) - 1 ELSE 0 END), lambda y, z: xor(y, z)) AS u FROM g)),
 y AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda z: 0::BIGINT)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS y),
 z AS (SELECT r, doc_id, strlen(t) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, v: xor(a >> 8, y[(xor(a, v) & 255) + 1]))) AS crc
  FROM (SELECT *, hex(encode(t)) AS h FROM d), y),
 a AS (SELECT doc_id, size, crc, place, ((2 * (sum(size) OVER (ORDER BY place, doc_id NULLS FIRST, crc ROWS UNBOUNDED PRECEDING)) - size) * 8 // (2 * sum(size) OVER ()))::INT AS shard FROM z JOIN o USING (r))
 SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, crc) - 1 AS slot, NULL::INT AS grown_shard FROM a""",
    "op12_prefix_trie": r"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
 b AS (SELECT c, c - c % 20 AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
   lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: 0::BIGINT)), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS r FROM (SELECT DISTINCT c FROM t)),
 h AS (SELECT c, base, xor(r, 4294967295) % 4 AS h, (SELECT count(*) FROM t WHERE t.c = b.base) AS lent FROM b),
 r AS (SELECT h.c, t.p AS d, role, text FROM h JOIN t ON t.c = h.base AND t.p <= h UNION ALL SELECT h.c, p - h + least(h, lent), role, text FROM h JOIN t ON t.c = h.c AND p > h),
 s AS (SELECT c, list({'role': role, 'text': text} ORDER BY d) AS l FROM r GROUP BY c),
 a AS (SELECT h.c, coalesce(l, []) AS l, len(coalesce(l, [])) AS n FROM h LEFT JOIN s USING (c)),
 k AS (SELECT c, n, d, sha256(l[1:d]::VARCHAR || d) AS k, CASE WHEN d > 0 THEN sha256(l[1:d - 1]::VARCHAR || (d - 1)) END AS pk, CASE WHEN d > 0 THEN len(list_filter(string_split_regex(l[d].text, '[ 	

]+'), lambda x: x <> '')) ELSE 0 END AS words
   FROM (SELECT c, l, n, unnest(range(n + 1)) AS d FROM a)),
 m AS (SELECT k, pk, d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM k GROUP BY k, pk, d),
 f AS (SELECT pk AS k, count(*) AS kids FROM m WHERE pk IS NOT NULL GROUP BY pk),
 u AS (SELECT x.k, sum(own) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves FROM (SELECT m.*, kids FROM m LEFT JOIN f USING (k)) y JOIN k x ON x.c = y.c AND x.d <= y.d GROUP BY x.k)
 SELECT m.c AS conv_id, m.d AS depth, q.c AS parent_conv_id, m.n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
  FROM m JOIN u USING (k) LEFT JOIN f USING (k) LEFT JOIN m q ON q.k = m.pk""",
    "op13_fill_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 u AS (SELECT *, string_split(t, chr(10)) AS l, list_transform(range(4), lambda i: ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT) AS r FROM d),
 n AS (SELECT *, len(l) - (l[-1] = '')::INT AS n FROM u),
 c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM n),
 o AS (SELECT *, least(length(t), coalesce(list_sum(list_transform(l[1:a], lambda x: length(x) + 1)), 0))::BIGINT AS p, least(length(t), coalesce(list_sum(list_transform(l[1:b], lambda x: length(x) + 1)), 0))::BIGINT AS q,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q] ELSE '<S>' || t[q + 1:] || '<P>' || t[1:p] || '<M>' || t[p + 1:q] END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM o""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
 SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 (((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
