"""The subpackage's queries and their SQL: `QUERIES` and `SQL`, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balanced_ann, chat_format, exact_dedup, html_extract, line_dedup, minhash_bayes, mixing, rendezvous, sentencepiece_bpe, toxicity
from .common import n_words, table

#: Shards of the sharding query.
SHARDS = 8


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece_bpe.encode(docs, "text")
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_balanced_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return balanced_ann.search(rows, F.col("vec_id") % 50 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents that goes, with the earliest line close to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_dedup.duplicate_lines(docs)
    return gone.select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line_no"), F.col("keep_doc").alias("keep_doc_id"), F.col("keep_line").cast("long").alias("keep_line_no"))


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight with equal weights, its slot there, and its shard of nine."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"))
    placed = rendezvous.assign(rows, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    return rendezvous.with_slots(placed, "doc_id", tie=("text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_bayes.cluster(docs).withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mixture of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(docs, "doc_id", "source", F.col("size")).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", F.col("shards").cast("array<string>")).alias("shards"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back from the formatted strings.

    Records come in two layouts: the table's rows gathered by conversation, and the added conversation -1 as a prompt
    with its completion, beside any that the table has under that id. Each record's fingerprint chooses its mapping,
    which sorts rows by turn, ties by role and text.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    gathered = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("table_rows"))
    none = F.lit(None).cast("string")
    records = gathered.select("conv_id", F.struct("table_rows", none.alias("prompt"), none.alias("completion")).alias("record"))
    kind = records.schema["record"].dataType["table_rows"].dataType
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.struct(F.lit(None).cast(kind).alias("table_rows"), hard.alias("prompt"), hard.alias("completion")).alias("record"))
    records = records.unionByName(extra)
    # in columns, not JSON: texts of any length pass
    records = records.withColumn("fingerprint", chat_format.struct_fingerprint(records, "record"))
    chats = records.select("conv_id", chat_format.struct_turns(records, "record", mark=F.col("fingerprint")).alias("turns"))
    done = chat_format.format_chat(chats).select("conv_id", "formatted", "loss_spans")
    back = done.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays of those with its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs, F.col("text"), "doc_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_html_extract": op2_html_extract,
    "op3_balanced_ann": op3_balanced_ann,
    "op4_line_dedup": op4_line_dedup,
    "op5_rendezvous": op5_rendezvous,
    "op6_minhash_bayes": op6_minhash_bayes,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
}

_UNIT = "('0x' || substr(md5({}), 1, 13))::BIGINT"


def _bid(s: int) -> str:
    return f"{{'u': -{_UNIT.format(f'''concat_ws(':', 'shard', k, '{s}')''')}, 's': {s}}}"


def _split_level(level: int) -> str:
    """One level of the splitting tree: of each node's quotas of a kind, half go left."""
    key = _UNIT.format(f"concat_ws(':', 'mix', 'split', '{level}', rank::VARCHAR, epoch::VARCHAR, unit::VARCHAR)")
    return f"""t{level + 1} AS (
    SELECT rank, epoch, unit, drawn, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node, drawn ORDER BY {key}, rank, epoch, unit) - 1 >= count(*) OVER (PARTITION BY node, drawn) // 2 THEN 1 ELSE 0 END AS node
    FROM t{level}
)"""


SQL: dict[str, str] = {
    "op4_line_dedup": f"""
WITH l0 AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL
), l AS (
    SELECT doc_id, line, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM l0
), x AS (
    SELECT w, array_to_string(w, ' ') AS s, min({{'d': doc_id, 'l': line}}) AS p FROM l WHERE len(w) > 0 GROUP BY w
), v0 AS (
    SELECT s, p, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM x WHERE len(w) >= {line_dedup.EDIT_WORDS}
), v AS (
    SELECT s, p, i, md5(array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ')) AS k FROM v0
), f AS (
    SELECT s, p, md5(s) AS k FROM x WHERE len(w) >= {line_dedup.EDIT_WORDS}
), near AS (
    SELECT s, min(p) OVER (PARTITION BY k, i) AS q FROM v
    UNION ALL SELECT v.s, f.p FROM v JOIN f USING (k)
    UNION ALL SELECT f.s, v.p FROM v JOIN f USING (k)
), m AS (
    SELECT s, min(q) AS q FROM near GROUP BY s
)
SELECT doc_id, line::BIGINT AS line_no, least(p, coalesce(q, p)).d AS keep_doc_id, least(p, coalesce(q, p)).l::BIGINT AS keep_line_no
FROM l JOIN x USING (w) LEFT JOIN m USING (s)
WHERE least(p, coalesce(q, p)) < {{'d': doc_id, 'l': line}}""",
    "op5_rendezvous": f"""
WITH RECURSIVE steps(i, k, v) AS (
    SELECT i, 0, i::UBIGINT FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), d AS (
    SELECT doc_id, doc_id::VARCHAR AS k, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents
), c AS (
    SELECT d.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, size), lambda j: ('0x' || substr(hx, 2 * j - 1, 2))::UBIGINT)),
        lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc
    FROM d, crc
), p AS (
    SELECT *, list_min([{", ".join(_bid(s) for s in range(SHARDS))}]).s AS shard,
        list_min([{", ".join(_bid(s) for s in range(SHARDS + 1))}]).s AS grown, {_UNIT.format("concat_ws(':', 'slot', k)")} AS h
    FROM c
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, crc, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM p""",
    "op7_mixing": f"""
WITH d AS (
    SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
        {_UNIT.format("concat_ws(':', 'mix', doc_id::VARCHAR)")} AS h
    FROM documents
), s0 AS (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), s1 AS (
    SELECT *, (rank % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM s0
), s2 AS (
    SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS heavy,
        coalesce(sum(cap) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone
    FROM s1 WINDOW w AS (ORDER BY cap::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
    SELECT *, (total - capped)::DOUBLE / (heavy - gone)::DOUBLE AS share FROM s2
), s4 AS (
    SELECT *, (min({{'ratio': ratio, 'rank': rank, 'share': share}}) FILTER (share * weight <= cap) OVER ()).share AS lam FROM s3
), s AS (
    SELECT source, source_size, n, rank, least(cap::DOUBLE, coalesce(lam * weight, cap::DOUBLE)) AS target FROM s4
), p AS (
    SELECT d.*, rank, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
        h % least({mixing.MAX_BLOCKS}, ceil(n / {mixing.BLOCK_ROWS}.0)::BIGINT) AS block
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), b AS (
    SELECT rank, block, any_value(target) - any_value(epochs) * any_value(source_size) AS rest, any_value(epochs) AS epochs, any_value(source_size) AS source_size, sum(size) AS words
    FROM p GROUP BY rank, block
), k AS (
    SELECT rank, count(*) AS n, any_value(epochs) AS epochs, CASE WHEN any_value(source_size) > 0 THEN floor(count(*)::DOUBLE * any_value(rest) / any_value(source_size)) ELSE 0 END AS part
    FROM b GROUP BY rank
), u0 AS (
    SELECT rank, epochs, part, n, unnest(range(epochs + 1)) AS epoch FROM k
), u1 AS (
    SELECT rank, epoch, epochs, part, unnest(range(n)) AS unit FROM u0
), t0 AS (
    SELECT rank, epoch, unit, epoch < epochs OR unit < part AS drawn, 0 AS node FROM u1
), {", ".join(_split_level(level) for level in range(mixing.LEVELS))}, leaf AS (
    SELECT *, row_number() OVER (PARTITION BY rank, epoch ORDER BY node, drawn DESC, unit) AS place FROM t{mixing.LEVELS}
), e0 AS (
    SELECT *, unnest(range(epochs + 1)) AS epoch FROM b
), e1 AS (
    SELECT *, {_UNIT.format("concat_ws(':', 'mix', 'perm', rank::VARCHAR, epoch::VARCHAR, block::VARCHAR)")} AS perm FROM e0
), e2 AS (
    SELECT *, row_number() OVER (PARTITION BY rank, epoch ORDER BY perm, block) AS place FROM e1
), dealt AS (
    SELECT e2.*, node, drawn FROM e2 JOIN leaf USING (rank, epoch, place)
), b2 AS (
    SELECT rank, block, words, rest - coalesce(sum(words) OVER (PARTITION BY rank ORDER BY drawn DESC, perm, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM dealt WHERE epoch = epochs
), sh AS (
    SELECT rank, block, list(node ORDER BY epoch) AS shards FROM dealt GROUP BY rank, block
), q AS (
    SELECT p.*, room, words, coalesce(sum(size) OVER (PARTITION BY p.rank, p.block ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM p JOIN b2 USING (rank, block)
), c AS (
    SELECT rank, block, max(h) AS cut FROM q
    WHERE words > room AND room > 0 AND (before + size - room <= 0 OR (before < room AND before + size - room <= room - before))
    GROUP BY rank, block
), z AS (
    SELECT q.*, epochs + CASE WHEN words <= room OR h <= cut THEN 1 ELSE 0 END AS copies FROM q LEFT JOIN c USING (rank, block)
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, array_to_string(shards[:copies], ',') AS shards
FROM z JOIN sh USING (rank, block)""",
    "op8_chat_format": r"""
WITH r AS (
    SELECT conv_id, false AS added, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, true, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, true, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, regexp_replace(replace(text, '\', '\\'),
        '([<\[])(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>)', '\1\\\2', 'g') AS esc
    FROM r
)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(12 + length(role) + 1 + length(esc) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, added""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
