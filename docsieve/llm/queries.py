"""Queries of this subpackage: name -> builder, and SQL where SQL can say the same. Parameters are the production ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(builder):
        QUERIES[name] = builder
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 1: URL filters

_PREFIX_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

_URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j(name) AS (VALUES ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm'), ('ads-track')),
f AS (SELECT s.*, (SELECT max(struct_pack(l := length(h || p), rule := h || p, action := action)) FROM r
                   WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS won,
             (SELECT min('||' || name || '.') FROM j WHERE starts_with(host, name || '.') OR contains(host, '.' || name || '.')) AS junk FROM s)
SELECT page_id, host, path, won.rule AS rule, CASE WHEN won IS NOT NULL THEN won.action WHEN junk IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN won IS NULL THEN junk END AS pattern
FROM f"""


@_query("op1_url_filters", _URL_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.url_filters import PATTERNS, Rule, judged

    return judged(_table(spark, folder, "pages"), [Rule(t, a) for t, a in _PREFIX_RULES] + list(PATTERNS))


# --- 7: sharding


_ROUNDS = 6
_P = 2147483647


def _sharding_sql() -> str:
    """Row numbers by bucket of an MD5, the Feistel rounds as one select each, cycle walking as a recursion, CRC-32 byte by byte."""
    from docsieve.llm.sharding import BUCKET_ROWS, round_keys

    rounds = []
    for i, key in enumerate(round_keys(1)):
        t = f"((y + {key}) % {_P})"
        mixed = f"(({t} * {t}) % {_P}) * (({t} + {key // 2 + 1}) % {_P}) % {_P}"
        rounds.append(f"e{i + 1} AS (SELECT n, y AS x, (x + {mixed}) % {'b' if i % 2 else 'a'} AS y, a, b FROM e{i})")
    return f"""
WITH RECURSIVE t AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '[0-9A-F][0-9A-F]'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, v: xor(t[xor(c, v) % 256 + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM h, t),
k AS (SELECT *, greatest((SELECT count(*) FROM (SELECT DISTINCT doc_id, size, text_crc32 FROM c)) // {BUCKET_ROWS}, 1) AS buckets FROM c),
n AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), size, text_crc32)), 1, 15) AS BIGINT) % buckets,
        doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number, count(*) OVER () AS rows FROM k),
r AS (SELECT max(rows) AS rows, CAST(ceil(sqrt(max(rows))) AS BIGINT) AS a FROM n),
ab AS (SELECT rows, a, (rows + a - 1) // a AS b FROM r),
e0 AS (SELECT n, n // b AS x, n % b AS y, a, b FROM (SELECT unnest(range(0, a * b)) AS n, a, b FROM ab)),
{", ".join(rounds)},
e AS (SELECT n, x * b + y AS place FROM e{_ROUNDS}),
w AS (SELECT n, place FROM e UNION ALL SELECT w.n, e.place FROM w JOIN e ON e.n = w.place WHERE w.place >= (SELECT rows FROM ab)),
s AS (SELECT n, place FROM w WHERE place < (SELECT rows FROM ab) AND n < (SELECT rows FROM ab))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 8 AS INTEGER) AS shard, place // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
FROM n JOIN s ON s.n = n.row_number"""


@_query("op7_sharding", _sharding_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.sharding import shards

    return shards(_table(spark, folder, "documents"), n_shards=8)


# --- 3: benchmark decontamination

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM benchmark),
iw AS (SELECT item, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s, w FROM i WHERE len(w) > 0),
items AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, items.n, item FROM dw JOIN items ON dw.n = items.n AND array_to_string(w[s : s + dw.n - 1], ' ') = p),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


@_query("op3_decontamination", _DECONTAMINATION_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.decontaminate import contamination, is_contaminated

    found = contamination(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark"), window=13)
    found = found.select("doc_id", "contamination.n_words", "contamination.n_hit", "contamination.items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


# --- 6: near duplicates

_NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


@_query("op6_near_duplicates", _NEAR_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


# --- 8 and 10: tokenizers; their files are public ones installed beside the library


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op8_bpe_round_trip")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.bpe import round_trip

    both = round_trip(_table(spark, folder, "documents").select("doc_id", "text"), _vocabulary("word_bpe_49k.json"))
    return both.select(
        "doc_id",
        F.size("tokens.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.token_counts import with_token_counts

    counted = with_token_counts(_table(spark, folder, "documents").select("doc_id", "text"), _vocabulary("byte_bpe_50k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


# --- 2: near-duplicate vectors

_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.98 * a.n * b.n),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)"""


@_query("op2_near_vectors", _VECTOR_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.vectors import linked_vectors

    return linked_vectors(_table(spark, folder, "embeddings"), threshold=0.98)


# --- 5: WARC bundles

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS s FROM p),
f AS (SELECT n, s, min(page_id) AS first FROM h GROUP BY 1, 2),
d AS (SELECT h.*, first, list_transform(range(0, 8), lambda i: CAST('0x' || substr(s, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS q FROM h JOIN f USING (n, s))
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(q, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> k) % 32 + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM d"""


@_query("op5_warc_bundles", _WARC_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.common import shared_folder
    from docsieve.llm.warc import read_bundles, write_bundles

    index = write_bundles(_table(spark, folder, "pages"), shared_folder(spark, "warc"), least=0)
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --- 4: language


@_query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.common import held_out
    from docsieve.llm.language import learned_dictionaries, with_language

    documents = _table(spark, folder, "documents")
    told = with_language(documents.select("doc_id", "text"), learned_dictionaries(documents))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


# --- 9: toxicity


@_query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.common import held_out
    from docsieve.llm.toxicity import is_toxic, trained, with_toxicity

    documents = _table(spark, folder, "documents").select("doc_id", "text")
    scored = with_toxicity(documents, trained(documents, _table(spark, folder, "labels")))
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), is_toxic(score).cast("int").alias("predicted"))


# --- 11: alignment of two tokenizers


@_query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.alignment import aligned, with_alignment

    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = aligned(documents, _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return with_alignment(documents, found).select("doc_id", "alignment.*")


# --- 12: phrase collocations

_PHRASE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g, w[i : i + m - 1] AS ws FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m >= 2 AND f >= 10),
b AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, f, array_to_string(ws[1:2], ' ') AS g FROM c WHERE m = 3 UNION ALL SELECT lang, f, array_to_string(ws[2:3], ' ') FROM c WHERE m = 3) GROUP BY ALL),
k AS (SELECT c.lang, c.g, c.f AS a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1 : m], ' ') AS y
      FROM c LEFT JOIN b ON b.lang = c.lang AND b.g = c.g AND c.m = 2, (VALUES (1), (2)) v(k) WHERE k < m AND (longer IS NULL OR 100 * longer < 50 * c.f)),
s AS (SELECT k.lang, k.g, a, k, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = k.x JOIN f y ON y.lang = k.lang AND y.g = k.y),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM o)
SELECT t.lang, rank, g AS phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""


@_query("op12_collocations", _PHRASE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.collocations import collocations

    return collocations(_table(spark, folder, "documents"), max_words=3, min_count=10, covered=50, top=2000)


# --- 13: language model


@_query("op13_lm_scoring")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from docsieve.llm.ngram_lm import trained, with_score

    documents = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    model = trained(documents.where(~held_out))
    scored = with_score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")
