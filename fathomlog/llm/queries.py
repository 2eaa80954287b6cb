"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer file that op3 and op10 use; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.sharding import shard_rows

    out = shard_rows(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm import quality
    from fathomlog.llm.training import remainder

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return _scored(quality.score(docs, model), remainder(F.col("doc_id"), 3) == 1)


def _scored(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, separator=0)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.simhash import near_groups

    out = near_groups(_table(spark, sf_dir, "documents"), words=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.exact_dedup import exact_groups

    out = exact_groups(_table(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm import toxicity
    from fathomlog.llm.training import remainder

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return _scored(toxicity.score(docs, net), remainder(F.col("doc_id"), 5) == 0)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.word_bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.fingerprints import entropy_ranks, neighbours

    docs = _table(spark, sf_dir, "documents")
    return neighbours(docs, entropy_ranks(docs)).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm import filter_audit as fa

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filters = {"A": fa.too_few_words(text), "B": fa.repetitive(text), "C": fa.many_capitals(text), "D": fa.has_symbols(text)}
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return fa.audit(fa.flagged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), filters, "E", part), "ABCDE")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomlog.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality": op2_quality,
        "op3_packing": op3_packing,
        "op4_suffix_array": op4_suffix_array,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_topk": op7_topk,
        "op8_toxicity": op8_toxicity,
        "op9_html": op9_html,
        "op10_word_bpe": op10_word_bpe,
        "op11_fingerprints": op11_fingerprints,
        "op12_filter_audit": op12_filter_audit,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                       WHERE vec_id IS NOT NULL AND len(embedding) > 0
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op12_filter_audit": r"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
            w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
            l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
            m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(first_id < w.doc_id, false) THEN 16 ELSE 0 END AS mask
                  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
            g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
            f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
            o AS (SELECT '' AS path, 0 AS used UNION ALL SELECT path || letter, used | bit FROM o, f WHERE used & bit = 0),
            s AS (SELECT o.path AS filter_order, CAST(i.i AS INTEGER) AS step, f.bit,
                    CAST((SELECT coalesce(sum(b.bit), 0) FROM f b WHERE position(b.letter IN o.path) < i.i) AS INTEGER) AS before
                  FROM o, (SELECT unnest(range(1, 6)) AS i) i, f WHERE length(o.path) = 5 AND substr(o.path, CAST(i.i AS INTEGER), 1) = f.letter),
            r AS (SELECT part, filter_order, step, bit,
                    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
                    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
                  FROM g, s GROUP BY part, filter_order, step, bit)
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
                   CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
                   CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
        "op13_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
            t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
            v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
            c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
            grp AS (SELECT DISTINCT lang, source FROM d),
            tot AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = grp.lang AND c.source = grp.source), 0) AS total FROM grp),
            p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                    1 + CAST((1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // CAST(g.total + v.terms AS HUGEINT) AS HUGEINT) AS p
                  FROM tot g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            pairs AS (SELECT a.lang, a.source, b.source AS item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
            pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pr AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN pv USING (lang, source, item)),
            al AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
            ln AS (SELECT lang, sum(n) AS total FROM al GROUP BY lang),
            q AS (SELECT lang, term, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // CAST(total + terms AS HUGEINT) AS q FROM al JOIN ln USING (lang) JOIN v USING (lang)),
            tv AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM
              (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tv))
            WHERE part = 'pair' OR rank <= 200""",
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    }
