"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.llm import (
    bitplanes, context_mixing, decontamination, digest_merge, filter_audit, language, mixing, sharding, simhash, token_files,
    topk, url_rules, warc,
)
from tamiz.llm.registry import QUERIES, SQL, query, table  # noqa: F401

SHARDS = 8
#: Domains of the labels and their weights in the mixture.
DOMAINS = {"clean": 0.9, "poor": 0.1, "toxic": 0.0}
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(
    """
    WITH crc AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
    d AS (
        SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
            xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1])), 4294967295) AS text_crc32,
            concat_ws(':', (source IS NOT NULL)::VARCHAR, source) AS stratum,
            md5('0|' || coalesce(doc_id::VARCHAR, '')) AS hash
        FROM documents, crc),
    ranked AS (
        SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY hash, text_crc32, size) - 1
            + ('0x' || md5('0|' || stratum)[1:8])::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS place
        FROM d),
    dealt AS (
        SELECT *, row_number() OVER (ORDER BY place, stratum, hash, text_crc32, size) - 1 AS spot, count(*) OVER () AS total
        FROM ranked)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (spot * 8 // total)::INTEGER AS shard,
        spot - (spot * 8 // total * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard, source
    FROM dealt
    """
)
def op2_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.measured(table(spark, folder, "documents"))
    placed = sharding.interleave(rows, SHARDS, ties=("text_crc32", "size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


@query(
    """
    WITH rules(verdict, host, path) AS (VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    parts AS (
        SELECT page_id, url, CASE WHEN contains(url, '://')
            THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    named AS (
        SELECT page_id, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
    fitting AS (
        SELECT n.page_id, r.verdict, r.host || r.path AS rule,
            row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.host || r.path) DESC) AS place
        FROM named n JOIN rules r
          ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path))
    SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM named n LEFT JOIN fitting f ON f.page_id = n.page_id AND f.place = 1
    """
)
def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    judged = url_rules.judge(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op1_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    dictionaries = language.fit(docs.where(~held_out))
    found = language.identify(docs.withColumn("held_out", held_out), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


@query(
    """
    WITH sized AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages),
    latest AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS latest
        FROM sized)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> latest THEN latest END AS refers_to
    FROM latest
    """
)
def op3_seekable_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive(table(spark, folder, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def byte_tokenizer() -> str:
    """The tokenizer file that every machine of the cluster has at the same path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    read = token_files.round_trip(docs, byte_tokenizer())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op10_simhash_gray(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), distance=2, words=3)


def domain_model(docs: DataFrame, labels: DataFrame) -> mixing.DomainModel:
    """A classifier of the labels' domains: toxic, else by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    named = labels.select("doc_id", domain.alias("domain")).where("domain is not null")
    return mixing.fit_domains(docs.select("doc_id", "text"), named, list(DOMAINS))


@query()
def op5_soft_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = domain_model(docs, table(spark, folder, "labels"))
    # Copies above 1, so that a scarce domain reaches its target.
    mixed = mixing.mix(docs, model, list(DOMAINS.values()), keep=["doc_id"], most=None)
    posterior = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", "tokens", *posterior, "rate", "copies")


@query()
def op6_edit_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.ints::DOUBLE[], c.ints::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """
)
def op4_impact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"), 1024)
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query()
def op7_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = context_mixing.score_texts(docs, ~held_out)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query(
    """
    WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, text_sha256
    FROM hashed WINDOW same AS (PARTITION BY text_sha256)
    """
)
def op11_digest_merge(spark: SparkSession, folder: str) -> DataFrame:
    return digest_merge.mark_copies(table(spark, folder, "documents"), keep="largest")


CENTROIDS, ROUNDS, SEED = 40, 5, 2


def _assigned(centroids: str) -> str:
    """Every vector's nearest centroid, by exact sums of products."""
    return f"""SELECT v.vec_id, v.c, min({{'distance': (
            list_inner_product(v.c, v.c) - 2 * list_inner_product(v.c, k.c) + list_inner_product(k.c, k.c))::BIGINT,
            'cluster': k.cluster}}) AS near FROM v, {centroids} k GROUP BY v.vec_id, v.c"""


def _moved(before: str, assigned: str) -> str:
    """The floors of the means of what was assigned."""
    return f"""SELECT k.cluster, coalesce(m.c, k.c) AS c FROM {before} k LEFT JOIN (
            SELECT cluster, list(floor((total - ((total % n) + n) % n) / n)::DOUBLE ORDER BY i) AS c FROM (
                SELECT near.cluster AS cluster, i, sum(c[i])::BIGINT AS total, count(*) AS n
                FROM {assigned}, range(1, 65) AS r(i) GROUP BY ALL) GROUP BY cluster) m USING (cluster)"""


def _rounds() -> str:
    steps = []
    for i in range(ROUNDS):
        steps += [f"a{i} AS MATERIALIZED ({_assigned(f'c{i}')})", f"c{i + 1} AS MATERIALIZED ({_moved(f'c{i}', f'a{i}')})"]
    return ",\n    ".join([*steps, f"a{ROUNDS} AS MATERIALIZED ({_assigned(f'c{ROUNDS}')})"])


@query(
    f"""
    WITH v AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id))::INTEGER - 1 AS cluster, c FROM v
        ORDER BY cluster LIMIT {CENTROIDS}),
    {_rounds()}
    SELECT vec_id, near.cluster AS cluster, near.distance AS distance,
        (sum(near.distance) OVER (PARTITION BY near.cluster))::BIGINT AS cluster_inertia,
        (sum(near.distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(list_transform(k.c, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.cluster = near.cluster
    """
)
def op12_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = bitplanes.integer_vectors(table(spark, folder, "embeddings"), 256)
    return bitplanes.cluster(vectors, CENTROIDS, ROUNDS, SEED)


@query(
    r"""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
    known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    judged AS (
        SELECT part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic, {
            'A': len(words) < 200,
            'B': 100 * len(list_distinct(words)) < 50 * len(words),
            'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
            'D': regexp_matches(text, '[#$%&*|]'),
            'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS f
        FROM docs d LEFT JOIN known k ON k.doc_id = d.doc_id),
    failing AS (
        SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: [f.A, f.B, f.C, f.D, f.E][ascii(x) - 64]) AS fails
        FROM judged),
    kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
    letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (
        SELECT filter_order, i::INTEGER AS step, filter_order[i] AS letter, string_split(filter_order[:i - 1], '') AS earlier
        FROM orders, range(1, 6) AS r(i)),
    told AS (
        SELECT *, list_contains(fails, letter) AS failing, step > 1 AND list_has_any(fails, earlier) AS gone FROM kinds, steps),
    counted AS (
        SELECT part, filter_order, step, letter,
            coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (fails = [letter]), 0)::BIGINT AS unique_fails,
            coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0)::BIGINT AS good_lost,
            coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
        FROM told GROUP BY ALL)
    SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
    """
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, folder, "documents").select("doc_id", "lang", text.alias("text"), words.alias("words"))
    filters = {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }
    labels = table(spark, folder, "labels")
    labels = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit(docs, labels, filters, copies="E")
