"""The queries of the subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    decontamination, exact_dedup, line_dedup, merkle, mixing, ngram_join, oracles, packing, quality, records, secrets,
    spelling, substrings, topk,
)
from tidegauge.llm.common import table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# What a document is made of, from its whole text, and its weight in words.
TOPIC_SQL = """CASE WHEN text LIKE '% | %' THEN 'table'
    WHEN text LIKE '%***%' OR text LIKE '%!!%' THEN 'marked'
    WHEN {digits} THEN 'numbers'
    WHEN length(text) < 1000 THEN 'brief' ELSE 'article' END"""
QUALITY_LEAST = 0.3
MIX_PART, MIX_SEED = 0.4, 11
MIX_POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.0}


def with_topic(docs: DataFrame) -> DataFrame:
    """Add ``topic`` and ``tokens`` (words) of each document."""
    topic = TOPIC_SQL.format(digits="rlike(text, '[0-9]{7}')")
    text = text_or_empty("text")
    return docs.withColumns({"topic": F.expr(topic), "tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def mixing_targets() -> dict[str, Column]:
    return {name: mixing.tempered(power) for name, power in MIX_POWERS.items()}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(with_topic(docs), mixing_targets(), "tokens", MIX_PART, MIX_SEED)


def mixing_sql() -> str:
    names = list(MIX_POWERS)
    steps = [
        f"""{n}_t AS (SELECT {n} AS v, sum(tokens) / (SELECT sum(tokens) FROM cells) AS share, sum(tokens) ** {p} AS w
            FROM cells GROUP BY {n}),
        {n}_s AS (SELECT v, share, w / (SELECT sum(w) FROM {n}_t) AS s FROM {n}_t)"""
        for n, p in MIX_POWERS.items()
    ]
    joins = " ".join(
        f"JOIN {n}_g ON {n} IS NOT DISTINCT FROM {n}_g.v AND {n}_g.fraction = x.fraction" for n in names)
    bounds = ", ".join(
        f"greatest({mixing.LEAST_PART}, (SELECT min(share / s) FROM {n}_s))" for n in names)
    fractions = ", ".join(f"({x}::DOUBLE)" for x in mixing.FRACTIONS)
    factors = " * ".join(f"f_{n}" for n in names)
    steps.append(
        f"x AS (SELECT fraction, fraction * least({MIX_PART}, {bounds}) AS part FROM (VALUES {fractions}) x(fraction))")
    for n in names:
        steps.append(f"""{n}_r AS (SELECT v, s, fraction, share / part AS most,
            (1 - coalesce(sum(share / part) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(s) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up
            FROM {n}_s, x WINDOW w AS (PARTITION BY fraction ORDER BY s / (share / part) DESC)),
        {n}_g AS (SELECT v, fraction, least(most, s * max(up) OVER (PARTITION BY fraction)) AS g FROM {n}_r)""")
    steps.append(
        f"""r0 AS (SELECT {', '.join(names)}, tokens, x.fraction, {', '.join(f'{n}_g.g AS g_{n}' for n in names)},
            {', '.join(f'1.0::DOUBLE AS f_{n}' for n in names)}, part * (SELECT sum(tokens) FROM cells) AS wanted
            FROM cells CROSS JOIN x {joins})"""
    )
    for i in range(mixing.SWEEPS * len(names)):
        n = names[i % len(names)]
        others = " * ".join(f"f_{m}" for m in names if m != n)
        steps.append(
            f"""q{i} AS MATERIALIZED (SELECT *, (g_{n} * wanted - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(tokens * ({others})) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
            FROM r{i} WINDOW w AS (PARTITION BY fraction, {n} ORDER BY {others} DESC)),
            r{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (own) REPLACE (least({1 / mixing.LEAST}, greatest({mixing.LEAST},
            max(own) OVER (PARTITION BY fraction, {n}))) AS f_{n}) FROM q{i})"""
        )
    away = ", ".join(
        f"abs(sum(e) OVER (PARTITION BY fraction, {n}) / sum(e) OVER (PARTITION BY fraction) - g_{n})" for n in names)
    return f"""
    WITH docs AS (
        SELECT doc_id, source, lang, {TOPIC_SQL.format(digits="regexp_matches(text, '[0-9]{7}')")} AS topic,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
        FROM documents
    ), cells AS (
        SELECT {', '.join(names)}, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0
    ), {', '.join(steps)},
    raked AS (SELECT *, least(1.0, {factors}) AS p, tokens * least(1.0, {factors}) AS e FROM r{mixing.SWEEPS * len(names)}),
    away AS (SELECT *, greatest({away}) AS away FROM raked),
    pick AS (
        SELECT fraction FROM away GROUP BY fraction
        ORDER BY CASE WHEN max(away) <= {mixing.TOLERANCE} THEN -fraction ELSE max(away) END LIMIT 1
    ), f AS (SELECT * FROM raked WHERE fraction = (SELECT fraction FROM pick)),
    p AS (
        SELECT d.*, CASE WHEN d.tokens > 0 THEN f.p ELSE 0 END AS probability
        FROM docs d LEFT JOIN f ON {' AND '.join(f'd.{n} IS NOT DISTINCT FROM f.{n}' for n in names)}
    )
    SELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability,
        ('0x' || substr(md5(doc_id || '|{MIX_SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS sampled
    FROM p
    """


@query(mixing_sql())
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents").drop("n_chars")).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), "sampled"
    )


@query()
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"))


@query()
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_token_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.read_files(records.write_records(table(spark, folder, "documents"), tokenizer_file()))


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file())


def quality_model(spark: SparkSession, folder: str) -> quality.Model:
    labels = table(spark, folder, "labels").where(~quality.held_out())
    return quality.fit(table(spark, folder, "documents"), labels)


@query()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, folder)).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"),
    )


@query(
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), win AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
    ), low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT doc_id, i FROM win JOIN low USING (h) WHERE doc_id > m),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
    word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (
        SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS k, count(*) AS n
        FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """
)
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents"), with_text=False)
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """
)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.label(table(spark, folder, "documents"))


@query(oracles.decontamination_sql())
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.digest(decontamination.find(docs, items))


@query(oracles.manifest_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.digest(merkle.manifest(table(spark, folder, "documents")))


@query(oracles.spelling_sql())
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
