"""Registered query that damages conversations by checksum and repairs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import conversations
from lamina.llm.common import table
from lamina.llm.registry import query

#: The checksum is folded from a table that the first common table expression derives from the CRC-32 polynomial.
_SQL = r"""
WITH RECURSIVE bits(byte, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS code
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM coded WHERE code <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut
  FROM damaged),
lines AS (
  SELECT *, is_blank OR seen AS gone, is_cut AND NOT (is_blank OR seen) AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank,
         count(*) FILTER (WHERE seen AND NOT is_blank) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
         count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM lines GROUP BY conv_id),
inserts(x, k, z, added) AS (VALUES
  ('E', 0, 'E', []), ('E', 1, 'U', ['user:']), ('E', 2, 'A', ['user:', 'assistant:']),
  ('S', 0, 'S', []), ('S', 1, 'U', ['user:']), ('S', 2, 'A', ['user:', 'assistant:']),
  ('U', 0, 'U', []), ('U', 1, 'A', ['assistant:']), ('U', 2, 'U', ['assistant:', 'user:']),
  ('A', 0, 'A', []), ('A', 1, 'U', ['user:']), ('A', 2, 'A', ['user:', 'assistant:'])),
ways AS (
  SELECT l.conv_id, l.i, s.x, s.z AS y, repeat('I', k) || 'D' AS letters, 3 * k + 4 AS price, s.added
  FROM lines l, inserts s
  UNION ALL
  SELECT l.conv_id, l.i, s.x, CASE WHEN z = 'U' THEN 'A' ELSE 'U' END, repeat('I', k) || 'R', 3 * k + 3 + CASE WHEN cut THEN 3 ELSE 0 END,
         list_append(s.added, CASE WHEN z = 'U' THEN 'assistant:' ELSE 'user:' END || l.text)
  FROM lines l, inserts s WHERE NOT l.gone
  UNION ALL
  SELECT l.conv_id, l.i, s.x, upper(l.initial), repeat('I', k) || 'K', 3 * k + CASE WHEN cut THEN 3 ELSE 0 END,
         list_append(s.added, l.role || ':' || l.text)
  FROM lines l, inserts s
  WHERE NOT l.gone AND ((l.initial = 's' AND z = 'E') OR (l.initial = 'u' AND z <> 'U') OR (l.initial = 'a' AND z = 'U'))),
paths(conv_id, i, x, cost, audit, made) AS (
  SELECT conv_id, 0, 'E', 0, '', CAST([] AS VARCHAR[]) FROM counted
  UNION ALL
  SELECT conv_id, i, y, cost, audit, made FROM (
    SELECT p.conv_id, w.i, w.y, p.cost + w.price AS cost, p.audit || w.letters AS audit, p.made || w.added AS made,
           row_number() OVER (PARTITION BY p.conv_id, w.y ORDER BY p.cost + w.price, p.audit || w.letters) AS place
    FROM paths p JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.x = p.x)
  WHERE place = 1),
ended AS (
  SELECT p.conv_id, p.cost + 3 * s.k AS cost, p.audit || repeat('I', s.k) AS audit, p.made || s.added AS made,
         row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 3 * s.k, p.audit || repeat('I', s.k)) AS place
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN inserts s ON s.x = p.x
  WHERE s.z = 'A' OR (s.z = 'E' AND s.k = 0))
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.place = 1
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Every twentieth row dropped, emptied, without its full stops, repeated, or said by the user; by checksum."""
    def known(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (rows.withColumn("code", code).where("code <> 0")
            .select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), copies.alias("copy"))
            .drop("copy"))


@query("op12_conversation_repair", _SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest repair, and a checksum of the repaired rows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(damaged(rows), conversations=rows.select("conv_id"))
