"""The registered queries of the corpus operators, and SQL twins where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import bpe, decontaminate, lexical, manifest, nearset, pii, pitmanyor, quotes, repeats, severity, topk, units, urlfilter
from veritab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'"
ORACLE["op2_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({LOW.format('text')}, '') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, {WORD}) AS words, string_split_regex(t, {WORD}) AS seps FROM d),
tok AS (
  SELECT r, j, sum(length(sep)) OVER p + sum(length(word)) OVER p - length(word) AS a, sum(length(sep)) OVER p + sum(length(word)) OVER p AS z
  FROM (SELECT r, unnest(range(len(words))) AS j, unnest(words) AS word, unnest(seps[1:len(words)]) AS sep FROM w) WINDOW p AS (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING)),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(coalesce({LOW.format('text')}, ''), {WORD}) AS words FROM benchmark),
pat AS (
  SELECT DISTINCT item, k, array_to_string(words[j + 1:j + k], ' ') AS win
  FROM (SELECT item, words, least(10, len(words)) AS k, unnest(range(len(words) - least(10, len(words)) + 1)) AS j FROM b WHERE len(words) > 0)),
place AS (
  SELECT r, k, j, array_to_string(words[j + 1:j + k], ' ') AS win
  FROM (SELECT r, words, k, unnest(range(len(words) - k + 1)) AS j FROM w, (SELECT DISTINCT k FROM pat) WHERE len(words) >= k)),
hit AS (SELECT DISTINCT r, j, k, item FROM place JOIN pat USING (k, win)),
cover AS (SELECT DISTINCT r, unnest(range(j, j + k)) AS j FROM hit),
island AS (
  SELECT r, min(a) AS a, max(z) AS z FROM (SELECT r, j, a, z, j - row_number() OVER (PARTITION BY r ORDER BY j) AS g FROM cover JOIN tok USING (r, j)) GROUP BY r, g),
spans AS (SELECT r, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM island GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
hits AS (SELECT r, count(*) AS n_hit FROM cover GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM w LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN spans USING (r)
"""


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


ORACLE["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(table(spark, sf_dir, "documents"))


@query
def op7_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.report(table(spark, sf_dir, "documents"))


@query
def op8_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scores(table(spark, sf_dir, "documents"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


ORACLE["op6_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS full_path FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
own AS (
  SELECT *, concat_ws(' ', CASE WHEN host LIKE '%spam%' THEN '*spam*|*' END, CASE WHEN host LIKE '%cheap-%' THEN '*cheap-*|*' END,
                      CASE WHEN host LIKE '%casino%' THEN '*casino*|*' END, CASE WHEN '.' || host LIKE '%.xxx' THEN '*.xxx|*' END,
                      CASE WHEN full_path LIKE '%/login%' THEN '*|*/login*' END, CASE WHEN full_path LIKE '%.exe' THEN '*|*.exe' END,
                      CASE WHEN full_path LIKE '%?%sessionid=%' THEN '*|*?*sessionid=*' END) AS matched FROM ruled)
SELECT page_id, host, path, rule, matched,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN matched <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM own
"""


@query
def op9_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearset.near_groups(table(spark, sf_dir, "documents"))


ORACLE["op9_near_groups"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(words[j + 1:j + 3], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 2, CAST(len(words) > 0 AS INT)))) AS j FROM w))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT r.x, b.y FROM reach r JOIN edge b ON r.y = b.x),
least_of AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


@query
def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.formatted(table(spark, sf_dir, "conversations"))


@query
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


# bytes as two hexadecimal digits each; a run of removed bytes is an island of covered places
ORACLE["op11_repeats"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS m FROM (SELECT r, h, unnest(range(strlen(h) // 2 - 399)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
islands AS (
  SELECT r, min(i) AS a, max(i) + 400 AS z FROM (
    SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit))
  GROUP BY r, k),
gaps AS (
  SELECT r, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS next_a FROM islands
  UNION ALL SELECT r, 0, min(a) FROM islands GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (coalesce(next_a, strlen(h) // 2) - z) AS BIGINT)), '' ORDER BY z) AS h FROM gaps JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM islands GROUP BY r)
SELECT doc_id, strlen(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_lexical"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stat AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stat GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL) JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), stat GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# the lowest bit of the CRC-32 of a decimal number, bit by bit
ODD = """(xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c:
       list_transform(range(8), lambda i: (ord(c) >> i) & 1))), lambda s, b: CASE WHEN (s & 1) <> b THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) & 1)"""
ORACLE["op13_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, leaf, claim, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT *, {_leaf('text')} AS leaf, CASE WHEN {ODD} = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claim FROM documents)),
low AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
top AS (
  SELECT 0 AS lvl, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, source FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)), NULL FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
beside AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM low a JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.pos),
above AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
climb AS (
  SELECT doc_id, source, leaf, pos AS place, 0 AS lvl, pos, claim AS h, '' AS proof FROM d
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.place, c.lvl + 1, c.pos // 3, sha256(b.before || c.h || b.after), c.proof || b.before || b.after
  FROM climb c JOIN beside b ON c.source IS NOT DISTINCT FROM b.source AND c.lvl = b.lvl AND c.pos = b.pos),
subs AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY source, place ORDER BY lvl DESC) = 1),
rise AS (
  SELECT s.doc_id, s.source, s.leaf, s.place, t.h AS subroot, 0 AS lvl, t.pos, s.h, s.proof FROM subs s JOIN top t ON t.lvl = 0 AND t.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.place, c.subroot, c.lvl + 1, c.pos // 3, sha256(b.before || c.h || b.after), c.proof || b.before || b.after
  FROM rise c JOIN above b ON c.lvl = b.lvl AND c.pos = b.pos),
ends AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY source, place ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, r.root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.root AS verified
FROM ends, (SELECT h AS root FROM top WHERE n = 1) r
"""
