"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import collocations, language_id, license_scan, merkle, mixing, ngram_join, nn_descent, piece_codec, ppm, quality, substring, toxicity, warc
from chatloom.llm.util import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("blocks")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(documents(spark, sf_dir))


def piece_model() -> bytes:
    """The public model that op3 and the pipeline encode with."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_decode(documents(spark, sf_dir), piece_model()))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    # pages carries no time: captures are a second apart from a fixed day on
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**9)))
    index = warc.archive_and_index(pages, "page_id", "url", "html", ts)
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.per_row(mixing.mix(documents(spark, sf_dir)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(documents(spark, sf_dir)).drop("text_hash")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", toxicity.held_out(modulus=7))
    scored = ppm.score(docs, ~F.col("held_out"))
    return scored.withColumn("held_out", toxicity.held_out(modulus=7))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scores = toxicity.toxicity_scores(docs, model, cut=0.3)
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.verify(merkle.prove(merkle.leaves(documents(spark, sf_dir), tampered)))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(~toxicity.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        e0 AS (SELECT doc_id, unnest(s) AS g FROM s),
        e AS (SELECT doc_id, g FROM e0 SEMI JOIN (SELECT g FROM e0 GROUP BY g HAVING count(*) > 1) t USING (g)),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
        r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM n JOIN m ON m.a = n.doc_id""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
        m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN m ON m.a = v.vec_id""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
        f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
        SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to,
               array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)), '.')), ',')
               || ')' || lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '#.*$', '')) AS url_key
        FROM p LEFT JOIN f ON p.html = f.html""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) ks WHERE len(w) >= k) x),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
        cover AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
                  FROM (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) ms WHERE m < k) y GROUP BY ALL),
        cuts AS (SELECT c.lang, c.phrase, c.a, t.n, x.a AS l, y.a AS r, q.i,
                   (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
                 FROM c JOIN t USING (lang) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i) q
                 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:q.i], ' ')
                 JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[q.i + 1:], ' ')
                 WHERE q.i < c.k),
        best AS (SELECT lang, phrase, a, n, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(s := score, i := i)) AS b FROM cuts GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE cover.most IS NULL OR 100 * cover.most < 100 * best.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    # crc32 is taken bit by bit over the digits of the id; `t` numbers the trees, -1 is the tree over the sources
    "op12_merkle_manifest": r"""
        WITH RECURSIVE
        d0 AS (SELECT *, row_number() OVER () AS rid, list_reduce(
                 list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                 lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                   lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc FROM documents),
        d AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 5 = 0
                THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other_text FROM d0),
        e AS (SELECT rid, doc_id, source, text, other_text,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
        f AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(other_text) || ':' || other_text, '-')) AS other FROM e),
        lf AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS t,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM f),
        lv(t, l, i, m, h) AS (
          SELECT t, 0, i, m, leaf FROM lf
          UNION ALL
          SELECT t, l + 1, i // 16, any_value((m + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE m > 1 GROUP BY t, l, i // 16),
        sub AS (SELECT t, h FROM lv WHERE m = 1),
        tv(l, i, m, h) AS (
          SELECT 0, t, count(*) OVER (), h FROM sub
          UNION ALL
          SELECT l + 1, i // 16, any_value((m + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE m > 1 GROUP BY l, i // 16),
        nodes AS (SELECT t, l, i, m, h FROM lv WHERE m > 1 UNION ALL SELECT -1, l, i, m, h FROM tv WHERE m > 1),
        depth AS (SELECT t, max(l) + 1 AS n FROM nodes GROUP BY t),
        place AS (SELECT lf.rid, n.t, n.l, lf.i // (16 ** n.l)::BIGINT AS i, n.l AS s FROM lf JOIN (SELECT DISTINCT t, l FROM nodes) n USING (t)
                  UNION ALL
                  SELECT lf.rid, -1, n.l, lf.t // (16 ** n.l)::BIGINT, coalesce(depth.n, 0) + n.l
                  FROM lf LEFT JOIN depth USING (t) CROSS JOIN (SELECT DISTINCT l FROM nodes WHERE t = -1) n),
        steps AS (SELECT p.rid, p.s, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < p.i), '') AS lo,
                    coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > p.i), '') AS hi
                  FROM place p JOIN nodes n ON n.t = p.t AND n.l = p.l AND n.i // 16 = p.i // 16 GROUP BY p.rid, p.s),
        way AS (SELECT rid, string_agg(lo || hi, '' ORDER BY s) AS w FROM steps GROUP BY rid),
        up(rid, s, h) AS (SELECT rid, 0, other FROM lf
                          UNION ALL SELECT up.rid, up.s + 1, sha256(lo || h || hi) FROM up JOIN steps USING (rid, s)),
        folded AS (SELECT rid, max_by(h, s) AS h FROM up GROUP BY rid)
        SELECT lf.doc_id, leaf, sub.h AS subroot, (SELECT h FROM tv WHERE m = 1) AS root, sha256(coalesce(w, '')) AS proof_sha256,
               folded.h AS folded_root, folded.h = (SELECT h FROM tv WHERE m = 1) AS verified
        FROM lf JOIN sub USING (t) JOIN folded USING (rid) LEFT JOIN way USING (rid)""",
}
