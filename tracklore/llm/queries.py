"""Registered queries of the training-data operators, each with its SQL equivalent where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklore.llm import (
    chains, decontamination, html_cut, imatch, mixing, ngram_join, periodic_runs, shards, suffix_dedup, token_spans, topk, toxicity, url_rules,
)
from tracklore.session import cut_lineage, prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


_ADDRESS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}'"
    for _v, host, path in sorted(url_rules.ADDRESS_RULES, key=lambda r: -len(r[1] + r[2]))
)
_VERDICT = " ".join(f"WHEN rule = '{host}{path}' THEN '{verdict}'" for verdict, host, path in url_rules.ADDRESS_RULES)


@query(
    "op6_url_verdicts",
    f"""WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
      FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
      regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    judged AS (SELECT *, CASE {_ADDRESS} END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE {_VERDICT}
      WHEN regexp_matches(host, '(^|[.-])({'|'.join(url_rules.BLOCKED_HOST_WORDS)})[.-]') THEN 'block'
      ELSE 'allow' END AS verdict FROM judged""",
)
def _(spark, d):
    rules = [url_rules.address_rule(*r) for r in url_rules.ADDRESS_RULES]
    rules += [url_rules.host_word_rule(w) for w in url_rules.BLOCKED_HOST_WORDS]
    judged = url_rules.judge_urls(table(spark, d, "pages"), url_rules.rule_table(spark, rules))
    return judged.drop("pattern_rule")


@query("op7_shards")
def _(spark, d):
    docs = table(spark, d, "documents")

    def crc(text):
        return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))

    size = shards.text_size(F.col("text"))
    sharded = shards.shuffle_into_shards(docs, [F.col("doc_id"), crc(F.col("text")), size], size)
    text = F.col("doc.text")
    digest = [shards.text_size(text).alias("size"), crc(text).alias("text_crc32")]
    return sharded.select("doc.doc_id", *digest, "law", "shard", "slot", "grown_shard")


@query(
    "op9_source_mix",
    """WITH sized AS (SELECT doc_id, source,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    caps AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
      2 * source_size AS cap FROM sizes),
    levels AS (SELECT *, row_number() OVER w AS place,
      (1.5::DOUBLE * CAST((SELECT sum(source_size) FROM sizes) AS BIGINT)
       - coalesce(CAST(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
       / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS per_weight
      FROM caps WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
    targets AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT arg_min(per_weight, place)
      FROM levels WHERE per_weight <= cap / weight)) AS target FROM levels),
    placed AS (SELECT s.doc_id, s.size, t.source_size, t.target,
      row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS place,
      ('0x' || substr(md5('7|' || coalesce('=' || s.source, 'null')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS shift,
      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      CAST((floor(shift + each * place) - floor(shift + each * (place - 1))) * size AS BIGINT) AS taken FROM placed""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(cut_lineage(sized), F.col("size"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op1_toxicity")
def _(spark, d):
    docs = table(spark, d, "documents")
    fitted = toxicity.fit_toxicity(docs, table(spark, d, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), fitted)
    return scored.select("doc.doc_id", toxicity.held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")


@query(
    "op4_exact_topk",
    """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10""",
)
def _(spark, d):
    vectors = topk.usable(table(spark, d, "embeddings"))
    return topk.exact_top_k(vectors.where("vec_id % 100 = 0"), vectors)


_WORDS = f"regexp_extract_all(translate(text, '{url_rules.UPPER}', '{url_rules.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op10_benchmark_hits",
    f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t
      FROM b, range(1, 100000) AS r(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), 13) + 1),
    places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
    found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, t)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def _(spark, d):
    hits = decontamination.benchmark_hits(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return decontamination.judged(hits).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


@query("op8_ngram_components")
def _(spark, d):
    groups = ngram_join.similar_groups(table(spark, d, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op5_main_text")
def _(spark, d):
    texts = html_cut.extract_main_text(table(spark, d, "pages").select("page_id", "url", "html"))
    return texts.select("page.page_id", "page.url", "text", "n_chars")


@query("op3_suffix_dedup")
def _(spark, d):
    cleaned = suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return cleaned.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_fuzzy_passages")
def _(spark, d):
    return chains.shared_passages(table(spark, d, "documents"))


@query("op11_periodic_runs")
def _(spark, d):
    docs = table(spark, d, "documents")
    found = periodic_runs.periodic_runs(docs, "doc_id", periodic_runs.planted_text(F.col("doc_id"), F.col("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return periodic_runs.with_strongest(found).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_imatch_fingerprints")
def _(spark, d):
    return imatch.fingerprints(table(spark, d, "documents"))


@query("op13_token_alignment")
def _(spark, d):
    return token_spans.align_tokens(table(spark, d, "documents"), token_spans.read_files())
