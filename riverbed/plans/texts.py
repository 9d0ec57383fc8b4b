"""Text, frames and vectors row by row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riverbed.catalog import query
from riverbed.functions import scalars as C
from riverbed.operators import text as T
from riverbed.sources.tables import table


@query("q_frames", """
WITH f AS (SELECT doc_id, n_chars AS total, unnest(range((n_chars + 1279) // 1280)) AS frame FROM documents)
SELECT doc_id, frame, frame * 1280 AS start, least((frame + 1) * 1280, total) AS frame_end, least((frame + 1) * 1280 + 200, total) AS observed, greatest(0, (frame + 1) * 1280 + 200 - total) AS padding FROM f""")
def q_frames(spark, sf_dir):
    """Frames of 1280 with 200 ahead, over n_chars as the length of a stream."""
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return d.select("doc_id", F.inline(C.frame_windows(F.col("n_chars"))))


SEGMENT = r"""CASE WHEN mark > 0 AND mark <= lim THEN mark
    WHEN length(rest) > lim THEN CASE WHEN strpos(left(rest, lim + 1), ' ') > 0 AND lim + 1 - strpos(reverse(left(rest, lim + 1)), ' ') > 0 THEN lim + 1 - strpos(reverse(left(rest, lim + 1)), ' ') ELSE lim END
    ELSE length(rest) END"""
MARK = r"""CASE WHEN regexp_matches(rest, '[.!?](?:\s+|$)') THEN length(regexp_extract(rest, '(?s)^.*?[.!?](?:\s+|$)')) ELSE 0 END"""
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("q_first_segment", f"""
WITH m AS (SELECT doc_id, text AS rest, 240 AS lim, {MARK.replace("rest", "text")} AS mark FROM documents), n AS (SELECT doc_id, rest, {SEGMENT} AS n FROM m)
SELECT doc_id, {TRIM.format("left(rest, n)")} AS segment, length(rest) - n AS rest_length FROM n""")
def q_first_segment(spark, sf_dir):
    """The first segment of at most 240 characters: a sentence with its white space, else what a blank allows."""
    return T.first_segment(table(spark, sf_dir, "documents", "doc_id", "text"), "text", 240).select("doc_id", "segment", "rest_length")


@query("q_segments", f"""
WITH RECURSIVE s(doc_id, step, lim, segment, rest) AS (
  SELECT doc_id, 0, 20, '', text FROM documents
  UNION ALL
  SELECT doc_id, step + 1, CASE WHEN segment <> '' THEN 40 ELSE lim END, segment, rest FROM (
    SELECT doc_id, step, lim, {TRIM.format("left(rest, n)")} AS segment, substr(rest, n + 1) AS rest FROM (
      SELECT *, {SEGMENT} AS n FROM (SELECT *, {MARK.replace("rest", "left(rest, 2000)")} AS mark FROM s WHERE rest <> ''))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INTEGER AS pos, segment FROM s WHERE segment <> ''""")
def q_segments(spark, sf_dir):
    """All segments of each text, at most 20 characters until the first that is not blank, then 40."""
    return T.segments(table(spark, sf_dir, "documents", "doc_id", "text"), "text", 40, 20)


@query("q_content_digest", "SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def q_content_digest(spark, sf_dir):
    """Digest of each text and the size of its group: counted by a partial aggregation and joined back, so a hot group is no single task."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.join(d.groupBy("digest").agg(F.count("*").alias("copies")), "digest").select("doc_id", "digest", "copies")


@query("q_quantise", """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(least(greatest(x::DOUBLE, -1.0), 1.0) * 32767)::INTEGER) AS pcm, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, list_sum(pcm)::BIGINT AS pcm_sum, list_max(pcm) AS pcm_max, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) AS rms, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS peak FROM q""")
def q_quantise(spark, sf_dir):
    """Vectors as samples: 16-bit values, root mean square and peak."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("pcm", F.transform("embedding", C.pcm16))
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("vec_id", total.alias("pcm_sum"), F.array_max("pcm").alias("pcm_max"), F.round(C.rms(F.col("embedding")), 6).alias("rms"), F.round(C.peak(F.col("embedding")), 6).alias("peak"))


@query("q_sft_messages", """
WITH c AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations)
SELECT conv_id, turn, asked, text AS answer, CASE WHEN length(text) < 300 THEN 0 ELSE 1 END AS loss_weight,
  concat_ws(',', CASE WHEN asked IS NULL THEN 'no_user' END, CASE WHEN length(text) < 300 THEN 'short_answer' END) AS blockers FROM c WHERE role = 'assistant'""")
def q_sft_messages(spark, sf_dir):
    """Training rows: each assistant turn with the latest user text before it, the weight of its loss, and what blocks it."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)).filter("role = 'assistant'")
    short = F.length("text") < 300
    blockers = F.array_compact(F.array(F.when(F.col("asked").isNull(), F.lit("no_user")), F.when(short, F.lit("short_answer"))))
    return c.select("conv_id", "turn", "asked", F.col("text").alias("answer"), F.when(short, 0).otherwise(1).alias("loss_weight"), F.concat_ws(",", blockers).alias("blockers"))


@query("q_message_rows", """
WITH c AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations),
a AS (SELECT * FROM c WHERE role = 'assistant' AND asked IS NOT NULL)
SELECT conv_id, turn, 0 AS pos, 'system' AS role, 'Answer briefly.' AS content, 0 AS loss_weight FROM a UNION ALL SELECT conv_id, turn, 1, 'user', asked, 0 FROM a UNION ALL SELECT conv_id, turn, 2, 'assistant', text, CASE WHEN text LIKE '%?%' THEN 0 ELSE 1 END FROM a""")
def q_message_rows(spark, sf_dir):
    """The messages array of each training row, opened: system, user and assistant, and the weight of each one's loss."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)).filter("role = 'assistant' and asked is not null")
    m = T.messages(F.lit("Answer briefly."), F.col("asked"), F.col("text"), F.contains("text", F.lit("?")))
    return c.select("conv_id", "turn", F.posexplode(m).alias("pos", "m")).select("conv_id", "turn", "pos", "m.*")


@query("q_canonical_nested", """
SELECT o_orderkey, '{"a":{"b":[' || o_custkey || ',null],"c":{"k":"' || o_orderstatus || '","z":null}},"m":{"' || o_orderstatus || '":1,"a":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '2' END || '},"z":"' || o_orderpriority || '"}' AS json FROM orders""")
def q_canonical_nested(spark, sf_dir):
    """Nested values as canonical JSON: fields and keys in order at every depth, nulls kept."""
    from riverbed.functions.canonical import canonical

    none = F.lit(None).cast("string")
    inner = F.struct(F.struct(none.alias("z"), F.col("o_orderstatus").alias("k")).alias("c"), F.array(F.col("o_custkey"), F.lit(None).cast("long")).alias("b"))
    pairs = F.map_from_arrays(F.array(F.lit("a"), F.col("o_orderstatus")), F.array(F.when(F.col("o_orderkey") % 2 == 1, 2), F.lit(1)))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").withColumn("x", F.struct(F.col("o_orderpriority").alias("z"), pairs.alias("m"), inner.alias("a")))
    return o.select("o_orderkey", canonical(F.col("x"), o.schema["x"].dataType).alias("json"))
