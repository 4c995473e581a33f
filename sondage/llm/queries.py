"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import ann, html_template, linededup, media, mixing, packing, simhash, substring, tokens, toxicity
from sondage.llm._io import Scratch
from sondage.session import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Arrow files and read back."""
    return tokens.token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.filter("vec_id % 20 = 0"), vectors)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    with Scratch(spark, "toxicity") as scratch:
        machine = toxicity.train(docs, labels, scratch)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture is drawn for every vector of embeddings; every picture is searched for the cropped and re-lit versions of
    those whose id is divisible by 20. Per row its class of equal pictures and how many of the queries are tied to it."""
    vectors = table(spark, sf_dir, "embeddings")
    pictures = media.textures_of(vectors, "vec_id", "embedding")
    queries = media.textures_of(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", edit=True)
    members, asked, links, scratch = media.find_copies(pictures, queries)
    with scratch:
        weight = asked.groupBy("query_class").agg(F.count("*").alias("n"), F.min("query_id").alias("first"))
        tied = links.join(weight, "query_class").groupBy("class_id").agg(F.sum("n").alias("n_links"), F.min("first").alias("first_query"), F.max("corners").alias("corners"))
        return scratch.keep(members.join(tied, "class_id", "left").select("media_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_query", "corners"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and passages of every document, but where they occur first."""
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("print")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_nearest_neighbours, op3_toxicity, op4_line_dedup, op5_best_fit_packing, op6_simhash, op7_media_copies, op8_main_text, op9_repeated_passages, op10_mix_sources)}

_LINES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, g.i AS i, string_split(text, chr(10))[g.i] AS line FROM d, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) g),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.i, k.line, (o.key IS NOT NULL AND k.doc_id <> o.owner) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w, 4 * n AS cap FROM s),
p AS (SELECT *, 3 * sum(n) OVER () - coalesce(sum(cap) OVER f, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS open
      FROM w WINDOW f AS (ORDER BY cap * (10 // w), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, rest * w > cap * open AS over FROM p),
z AS (SELECT rest AS r, open AS o FROM q WHERE NOT over ORDER BY cap * (10 // w), i LIMIT 1),
t AS (SELECT q.source, q.n::BIGINT AS n, CASE WHEN over THEN 2.0::DOUBLE * n::DOUBLE ELSE (z.r::DOUBLE / 2.0::DOUBLE) * w::DOUBLE / z.o::DOUBLE END AS target FROM q LEFT JOIN z ON true),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM d)
SELECT a.doc_id, a.size, t.n AS source_size, t.target,
       (CASE WHEN a.size = 0 THEN 0 ELSE least(greatest(floor(t.target)::BIGINT - a.at, 0), a.size) + least(greatest(floor(t.target)::BIGINT - t.n - a.at, 0), a.size) END)::BIGINT AS taken,
       a.source
FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source
"""

_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_PASSAGES = r"""
WITH t AS (SELECT doc_id, unnest(p) AS tok, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents)),
p AS (SELECT *, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM t),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, e - length(tok) AS s, e, translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS tok
      FROM p WHERE regexp_matches(tok, '^[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, k, s, lead(e, 49) OVER (PARTITION BY doc_id ORDER BY k) AS e, string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS h FROM w),
r AS (SELECT doc_id, s, e, row_number() OVER x AS n FROM u WHERE e IS NOT NULL WINDOW x AS (PARTITION BY h ORDER BY doc_id, k)),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM r WHERE n > 1),
i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS j FROM documents),
o AS (SELECT *, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM l),
y AS (SELECT doc_id, j, pos + length(line) - length(ltrim(line, c)) AS s, pos + length(rtrim(line, c)) AS e, translate(regexp_replace(trim(line, c), '[\x20\x09-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM o, (SELECT ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS c)),
z AS (SELECT *, first_value(doc_id) OVER v AS first_doc, row_number() OVER v AS n FROM y WHERE length(key) - length(replace(key, ' ', '')) >= 9 WINDOW v AS (PARTITION BY key ORDER BY doc_id, j))
SELECT doc_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", CAST(NULL AS BIGINT) AS first_doc, 'window' AS unit FROM i GROUP BY doc_id, island
UNION ALL SELECT doc_id, s::BIGINT, e::BIGINT, first_doc, 'line' FROM z WHERE n > 1
"""

#: What the pages of these tables are: one article, inline tags and few character references.
_ARTICLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?s)<!--.*?-->', '', 'g'), '</?(?:b|i|a|em|strong|span)(?: [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM c
"""

ORACLES: dict[str, str] = {"op8_main_text": _ARTICLE, "op9_repeated_passages": _PASSAGES, "op2_nearest_neighbours": _NEAREST, "op4_line_dedup": _LINES, "op10_mix_sources": _MIX}
