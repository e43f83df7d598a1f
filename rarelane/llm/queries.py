"""Registered queries of the operators: one each, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rarelane.llm.tables import table
from rarelane.session import staging_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


@query("op1_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written as flat files in key order, and read back."""
    import public_tokenizers

    from rarelane.llm.binary import read_tokens, write_tokens

    out = staging_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), False, 1)
    return read_tokens(spark, out)


@query("op4_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    from rarelane.llm.packing import packed_digests

    return packed_digests(table(spark, folder, "documents"))


@query("op2_simhash")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked at 4 or fewer differing bits."""
    from rarelane.llm.simhash import near_copies

    return near_copies(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op3_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item found in a document, with its edits and its place."""
    from rarelane.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of documents that repeat an earlier passage, with the place that is kept."""
    from rarelane.llm.units import repeated_spans

    return repeated_spans(table(spark, folder, "documents"))


@query("op10_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learnt from the labelled ones that are not held out."""
    from rarelane.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    from corpus_pipeline import run

    return run(spark, folder)


#: The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _level_sql(level: int) -> str:
    """CTEs that add one level of the template tree; a segment stays by 20 pages or by its form."""
    before, segment = f"t{level - 1}", f"s[{level + 1}]"
    number = r"^[^A-Za-z{}]*(\{[nh]\}[^A-Za-z{}]*)+([.][A-Za-z]{1,5})?$"
    return f"""
f{level} AS (SELECT host, template, {segment} AS segment FROM {before} WHERE {segment} IS NOT NULL
  GROUP BY 1, 2, 3 HAVING sum(pages) >= 20),
t{level} AS (SELECT t.host, masked, pages, labelled, bad, s, t.template || CASE
    WHEN {segment} IS NULL THEN ''
    WHEN f.segment IS NOT NULL OR {segment} = '' OR regexp_matches({segment}, '{number}') THEN '/' || {segment}
    ELSE '/*' END AS template
  FROM {before} t LEFT JOIN f{level} f ON f.host = t.host AND f.template = t.template AND f.segment = {segment}),"""


#: The paths of the given tables have at most four segments, so the tree is written out to that depth.
URL_SQL = rf"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT *, regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') AS masked,
    TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1) AS BIGINT) AS doc_id FROM p),
known AS (SELECT doc_id, max(greatest(CAST(quality = 0 AS INTEGER), CAST(toxic = 1 AS INTEGER))) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
t0 AS (SELECT host, masked, string_split(masked, '/') AS s, '' AS template, count(*) AS pages, count(bad) AS labelled,
    coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN known USING (doc_id) GROUP BY 1, 2, 3, 4),
{_level_sql(1)}{_level_sql(2)}{_level_sql(3)}{_level_sql(4)}
counts AS (SELECT host, template, string_split(template, '/') AS g, sum(labelled) AS labelled, sum(bad) AS bad
  FROM t4 GROUP BY 1, 2, 3),
placed AS (SELECT *, len(g) + 1 - list_position(list_reverse(list_transform(g,
    lambda x: x <> '' AND NOT regexp_matches(x, '[*{{}}]'))), true) AS place FROM counts),
branched AS (SELECT *, CASE WHEN place IS NULL THEN template
    ELSE array_to_string(list_transform(g, lambda x, i: CASE WHEN i = place THEN '*' ELSE x END), '/') END AS branch FROM placed),
parents AS (SELECT host, branch, sum(labelled) AS pl, sum(bad) AS pb, CAST(sum(bad) AS DOUBLE) / greatest(sum(labelled), 1) AS rate
  FROM branched GROUP BY 1, 2),
overall AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(labelled), 0), 0) AS share FROM counts),
far AS (SELECT b.*, pl, pb, abs(bad - labelled * rate) > 2 * sqrt(labelled * rate * (1 - rate)) AS alone
  FROM branched b JOIN parents USING (host, branch)),
judged AS (SELECT host, template, CASE WHEN alone THEN template ELSE branch END AS merged,
    (CASE WHEN alone THEN bad ELSE pb END + 10 * share) / (CASE WHEN alone THEN labelled ELSE pl END + 10) AS purity
  FROM far, overall),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM m)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL OR purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  merged AS template, round(purity, 6) + 0.0 AS purity
FROM ruled r JOIN t4 ON t4.host = r.host AND t4.masked = r.masked
JOIN judged j ON j.host = t4.host AND j.template = t4.template"""


@query("op8_url_filter", URL_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts for all urls, by rules and by path templates."""
    from rarelane.llm.urls import url_verdicts

    verdicts = url_verdicts(table(spark, folder, "pages"), table(spark, folder, "labels"), URL_RULES)
    return verdicts.withColumn("purity", F.round("purity", 6) + F.lit(0.0))


@query("op6_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    from rarelane.llm.html import main_texts

    return main_texts(table(spark, folder, "pages"))


@query("op7_lattice_score")
def lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of all documents under a subword model learnt from the others."""
    import public_tokenizers

    from rarelane.llm.lattice import text_scores

    return text_scores(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_nearest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    from rarelane.llm.neighbours import nearest

    return nearest(table(spark, folder, "embeddings"))


@query("op11_shards")
def shuffled_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents shuffled into 24 shard files, and read back; groups play no part in this law."""
    from rarelane.llm.shards import read_shards, write_shards

    docs = table(spark, folder, "documents")
    out = staging_path(spark, "shards")
    write_shards(docs, out, 24)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return read_shards(spark, out, docs.schema).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op12_periodic_runs")
def runs_of_words(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words that repeat four times or more, in all documents."""
    from rarelane.llm.periods import periodic_runs

    return periodic_runs(table(spark, folder, "documents"))


#: Terms are maximal runs of ASCII letters, digits and characters beyond ASCII.
_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), total),
c AS (SELECT term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))) AS c
  FROM p JOIN w USING (term), total),
s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY 1, 2 HAVING sum(c) > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 10"""


@query("op13_ranked_search", RANKED_SQL)
def ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    from rarelane.llm.ranked import ranked_search

    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
