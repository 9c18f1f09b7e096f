"""The corpus queries ``opN_<name>`` over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrace.llm import chat, decontam, htmltext, langid, mixing, pii, prefixtrie, quality, ranking, simhash, suffixtree, toxicity, warc
from iotrace.llm.common import bucket_of
from iotrace.storage import materialize


#: The rank file that token budgets are counted by.
TOKENIZER = "file:///opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled rows of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(docs, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = htmltext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_templates")


def op3_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document; texts labelled good are the trusted target."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), good)


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it in every document."""
    return pii.report(pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and suffix-tree log probability of every document."""
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in every document."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    out = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, out_col="language")
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefixtrie.nodes(table(spark, sf_dir, "conversations"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows and their loss spans."""
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_back(materialize(chat.windows(rows, TOKENIZER), "windows")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_main_text": op2_main_text,
    "op3_llr_quality": op3_llr_quality,
    "op4_disclosure": op4_disclosure,
    "op5_entropy_mix": op5_entropy_mix,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_windows": op13_chat_windows,
}

#: Base32 of a SHA-1 takes five hexadecimal digits as four letters of the alphabet.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM d""",
    "op11_ranked_search": r"""WITH t AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
  s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_all FROM t WHERE len(ts) > 0),
  c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM t) GROUP BY ALL),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  d AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c GROUP BY term),
  x AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all)))) AS BIGINT) AS score
    FROM q JOIN c USING (term) JOIN d USING (term), s GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50""",
    "op12_prefix_trie": r"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
  -- crc32, bit by bit: the table's entry of a byte is eight steps of its low bit
  t AS (SELECT n, list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS e FROM range(256) r(n)),
  e AS (SELECT list(e ORDER BY n) AS es FROM t),
  h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i + 1]) AS BIGINT))),
    lambda a, z: xor(a >> 8, es[(xor(a, z) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), e),
  r AS (SELECT h.conv_id, 0 AS part, o.p, x, b FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 AND o.p <= h UNION ALL SELECT o.conv_id, 1, o.p, x, b FROM o JOIN h ON o.conv_id = h.conv_id AND o.p > h),
  s AS (SELECT h.conv_id, coalesce(list(x ORDER BY part, p) FILTER (x IS NOT NULL), []) AS xs, list(b ORDER BY part, p) FILTER (x IS NOT NULL) AS bs FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
  m AS (SELECT conv_id, d, array_to_string(xs[1:d], '/') AS k, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], '/') END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, d = len(xs) AS ends
    FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM s)),
  n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY k, d),
  c AS (SELECT n.k, n.d, count(u.k) AS n_children FROM n LEFT JOIN n u ON u.up = n.k AND u.d = n.d + 1 GROUP BY n.k, n.d),
  a AS (SELECT m.k, m.d, sum(CAST(c.n_children = 0 AS INTEGER)) AS n_leaves, sum(n.own) AS saved FROM n JOIN c ON c.k = n.k AND c.d = n.d JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.k, m.d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN c ON c.k = n.k AND c.d = n.d JOIN a ON a.k = n.k AND a.d = n.d LEFT JOIN n p ON p.k = n.up AND p.d = n.d - 1""",
}
