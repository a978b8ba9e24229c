"""Replies of graders: where the JSON is, how it is mended, what it scores, and whether it is valid.

The tables hold no replies, so these queries build them from the events, in every shape that graders send: plain,
wrapped, fenced, with a trailing comma, a missing or a stray closer, in words, and as an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.json_repair import extracted, is_json, repair_json
from corpusloom.runtime import read_table

# --- fixed values ---
QUOTA = ["quota exceeded", "quota_exceeded", "resource exhausted", "resourceexhausted", "billing", "payment required", "insufficient_quota", "out of quota", "api key not valid", "api_key_invalid", "invalid api key", "permission denied", "access denied", "unauthorized", "authentication failed"]
RATE = ["rate limit", "rate_limit", "ratelimit", "too many requests", "429", "throttl", "slow down", "retry after", "requests per minute", "rpm limit", "tpm limit", "token limit", "context length exceeded"]
FAILED = ["failed to connect", "connection refused", "network error", "timeout", "timed out", "could not resolve", "ssl error", "api error", "model not found", "service unavailable", "internal server error", "bad gateway", "502", "503", "504", "connection reset", "broken pipe", "server not responding"]
SHAPES = 8


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, shape, score, reply)``"""
    e = read_table(spark, sf_dir, "events").where("event_id is not null").select("event_id").distinct()
    q = F.col("event_id") % 101
    e = e.withColumn("score", F.concat(F.expr("cast((event_id % 101) div 10 as string)"), F.lit("."), (q % 10).cast("string"))).withColumn("shape", (F.col("event_id") % SHAPES).cast("int"))
    s, lit, cat = F.col("score"), F.lit, F.concat
    shapes = [
        cat(lit('{"scores": {"a": 5}, "final_score": '), s, lit("}")),
        cat(lit('{"response": "```json\\n{\\"final_score\\": '), s, lit('}\\n```"}')),
        cat(lit('First:\n```json\n{"scores": {"a": 1}, "final_score": 0}\n```\nthen\n```json\n{"scores": {"a": 5}, "final_score": '), s, lit("}\n```\n")),
        cat(lit('{"scores": {"a": 5,}, "final_score": '), s, lit(",}")),
        cat(lit('Here it is: {"final_score": '), s, lit(', "scores": {"a": 5}, "notes": {"b": "x"}')),
        cat(lit('{"scores": {"a": 5]}, "final_score": '), s, lit("}")),
        cat(lit("Overall rating: "), s, lit(" of 10, unauthorized access is handled")),
        cat(lit('{"error": {"code": 429, "message": "Too many requests for '), s, lit('"}}')),
    ]
    return e.withColumn("reply", F.element_at(F.array(*shapes), F.col("shape") + 1))


def _holds(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def reply_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON part of a reply."""
    t = replies(spark, sf_dir).withColumn("t", extracted("reply"))
    return t.select("event_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("size"), is_json("t").alias("is_json"))


def reply_best_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all fenced objects with scores, the last with a positive final score, else the last."""
    blocks = F.filter(F.regexp_extract_all("reply", F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1)), lambda b: F.get_json_object(b, "$.scores").isNotNull())
    final = lambda b: F.coalesce(F.get_json_object(b, "$.final_score").cast("double"), F.lit(0.0))
    t = replies(spark, sf_dir).withColumn("b", blocks).withColumn("good", F.filter("b", lambda b: final(b) > 0)).where("size(b) > 0")
    best = F.when(F.size("good") > 0, F.element_at("good", -1)).otherwise(F.element_at("b", -1))
    return t.select("event_id", F.size("b").cast("bigint").alias("blocks"), final(best).alias("final_score"))


def mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with ``doc``, their mended object; a wrapper's inner reply takes the wrapper's place."""
    first = replies(spark, sf_dir).withColumn("doc", repair_json(extracted("reply")))
    inner = F.get_json_object("doc", "$.response")
    return first.withColumn("inner", inner).withColumn("doc", F.when(F.col("inner").isNotNull(), repair_json(extracted("inner"))).otherwise(F.col("doc")))


def reply_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a reply's object can be read, as sent and after mending."""
    t = mended(spark, sf_dir)
    return t.select("event_id", is_json("reply").alias("as_sent"), F.col("doc").isNotNull().alias("after"), F.get_json_object("doc", "$.final_score").cast("double").alias("final_score"))


def reply_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score by key, by the first pattern, by the second pattern, and where it was found."""
    number = lambda p: F.nullif(F.regexp_extract("reply", p, 1), F.lit("")).cast("double")
    t = mended(spark, sf_dir).select("event_id", F.get_json_object("doc", "$.final_score").cast("double").alias("k"), number(r"(?i)final_score[\"\s:]+(\d+(?:\.\d+)?)").alias("p"), number(r"(?i)(?:score|rating)[:\s]+(\d+(?:\.\d+)?)").alias("r"))
    where = F.when(F.col("k").isNotNull(), "key").when(F.col("p").isNotNull(), "pattern").when(F.col("r").isNotNull(), "words").otherwise("none")
    return t.select("event_id", F.coalesce("k", "p", "r").alias("score"), where.alias("found"))


def reply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested schema, required fields and ranges; the rules that a reply breaks, in order."""
    doc = F.from_json("doc", "struct<scores: struct<a: double, creativity: double>, final_score: double>")
    t = mended(spark, sf_dir).withColumn("d", doc)
    within = lambda c: F.col(c).between(0, 10)
    rules = {"unreadable": F.col("doc").isNull(), "no final_score": F.col("doc").isNotNull() & F.col("d.final_score").isNull(), "no scores": F.col("doc").isNotNull() & F.col("d.scores").isNull(), "final_score out of range": ~within("d.final_score"), "score out of range": ~within("d.scores.a")}
    broken = F.concat_ws("; ", *(F.when(r, name) for name, r in rules.items()))
    return t.select("event_id", (broken == "").alias("valid"), broken.alias("broken"), F.coalesce("d.scores.creativity", F.lit(5.0)).alias("creativity"))


def reply_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and documents that speak of quotas or limits, whatever else they hold."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("t")).select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.coalesce("t", F.lit("")).alias("t"))
    both = docs.unionByName(replies(spark, sf_dir).select(F.lit("reply").alias("source"), F.col("event_id").alias("id"), F.col("reply").alias("t")))
    low = F.lower("t")
    told = F.lower(F.concat_ws(" ", F.get_json_object("t", "$.error.code"), F.get_json_object("t", "$.error.status"), F.get_json_object("t", "$.error.message")))
    quota = _holds(low, QUOTA) | _holds(told, ["resource_exhausted", "quota", "billing", "permission"])
    rate = _holds(low, RATE) | _holds(low, FAILED) | _holds(told, ["429", "rate", "throttl", "too many"])
    return both.select("source", "id", quota.alias("quota"), rate.alias("limited"))


def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped score, percentage, status and notes."""
    s = reply_scores(spark, sf_dir)
    c = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce("score", F.lit(0.0))))
    notes = F.concat_ws(" | ", F.when(F.col("found") == "none", "no score"), F.when(F.col("found").isin("pattern", "words"), "score from text"), F.when(c == 0, "zero"))
    return s.select("event_id", c.alias("score"), F.round(c * 10, 2).alias("percent"), F.when((c == 0) | (c < 6), "needs_attention").otherwise("pass").alias("status"), notes.alias("notes"))


def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an entity's three providers the first with a valid score in their order counts."""
    s = reply_scores(spark, sf_dir).join(replies(spark, sf_dir).select("event_id", "shape"), "event_id")
    s = s.withColumns({"entity": F.expr("event_id div 3"), "place": F.col("event_id") % 3})
    valid = F.col("score").isNotNull() & (F.col("found") == "key") & F.col("score").between(0.1, 10)
    g = s.groupBy("entity").agg(*(F.max(F.when((F.col("place") == p) & valid, F.col("score"))).alias(f"p{p}") for p in range(3)))
    return g.select("entity", F.coalesce("p0", "p1", "p2").alias("score"), F.when(F.col("p0").isNotNull(), 0).when(F.col("p1").isNotNull(), 1).when(F.col("p2").isNotNull(), 2).alias("provider"))


def formatter_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratio and status of a formatter's report."""
    e = read_table(spark, sf_dir, "events").where("event_id is not null").select("event_id").distinct()
    a, b = F.col("event_id") % 7, F.col("event_id") % 12
    text = F.when(F.col("event_id") % 5 == 0, F.lit("")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Would reformat: a.py\nWould reformat: b.py\n"), b.cast("string"), F.lit(" files already formatted"))).otherwise(F.concat(a.cast("string"), F.lit(" files would be reformatted, "), b.cast("string"), F.lit(" file already formatted")))
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract("t", p, 1), F.lit("")).cast("bigint"), F.lit(0))
    t = e.withColumn("t", text).select("event_id", number(r"(\d+)\s+files? would be reformatted").alias("n"), number(r"(\d+)\s+files? already formatted").alias("formatted"), F.regexp_count("t", F.lit(r"(?m)^\s*Would reformat:")).cast("bigint").alias("named"))
    t = t.withColumn("unformatted", F.when(F.col("n") == 0, F.col("named")).otherwise(F.col("n"))).withColumn("total", F.col("unformatted") + F.col("formatted"))
    ratio = F.round(F.coalesce(F.try_divide(F.col("formatted") * 100.0, F.col("total")), F.lit(0.0)), 1)
    status = F.when((F.col("unformatted") == 0) & (F.col("total") > 0), "perfect").when(F.col("ratio") >= 80, "good").when(F.col("ratio") >= 50, "needs_work").when(F.col("total") > 0, "poor").otherwise("unknown")
    return t.withColumn("ratio", ratio).select("event_id", "unformatted", "formatted", "total", "ratio", status.alias("status"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (reply_extraction, reply_best_block, reply_repair, reply_scores, reply_validation, reply_limits, reply_status, provider_fallback, formatter_output)}

_R = r"""r AS (SELECT event_id, shape, score, CASE shape WHEN 0 THEN '{"scores": {"a": 5}, "final_score": ' || score || '}' WHEN 1 THEN '{"response": "```json\n{\"final_score\": ' || score || '}\n```"}'
WHEN 2 THEN 'First:' || chr(10) || '```json' || chr(10) || '{"scores": {"a": 1}, "final_score": 0}' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```json' || chr(10) || '{"scores": {"a": 5}, "final_score": ' || score || '}' || chr(10) || '```' || chr(10)
WHEN 3 THEN '{"scores": {"a": 5,}, "final_score": ' || score || ',}' WHEN 4 THEN 'Here it is: {"final_score": ' || score || ', "scores": {"a": 5}, "notes": {"b": "x"}' WHEN 5 THEN '{"scores": {"a": 5]}, "final_score": ' || score || '}'
WHEN 6 THEN 'Overall rating: ' || score || ' of 10, unauthorized access is handled' ELSE '{"error": {"code": 429, "message": "Too many requests for ' || score || '"}}' END AS reply
FROM (SELECT DISTINCT event_id, (event_id % 8)::INT AS shape, ((event_id % 101) // 10) || '.' || ((event_id % 101) % 10) AS score FROM events WHERE event_id IS NOT NULL))"""
_X = r"""b AS (SELECT *, regexp_replace(regexp_replace(reply, '(?m)^```(?:json)?\s*', '', 'g'), '(?m)```\s*$', '', 'g') AS bare FROM r), x AS (SELECT *, coalesce(nullif(regexp_extract(bare, '(?s)(\{.*\})', 1), ''), regexp_replace(bare, '^\s+|\s+$', '', 'g')) AS t FROM b)"""
# What mending must find, by the shape a reply was built in: the first object of two can't be told from the second (2),
# so such a reply stays unreadable; 6 has no object and 7 no score.
_K = "k AS (SELECT event_id, shape, reply, CASE WHEN shape IN (0, 1, 3, 4, 5) THEN score::DOUBLE END AS k, shape NOT IN (2, 6) AS readable FROM r)"
_S = r"s AS (SELECT event_id, shape, coalesce(k, nullif(regexp_extract(reply, '(?i)final_score[\"\s:]+(\d+(?:\.\d+)?)', 1), '')::DOUBLE, nullif(regexp_extract(reply, '(?i)(?:score|rating)[:\s]+(\d+(?:\.\d+)?)', 1), '')::DOUBLE) AS score, CASE WHEN k IS NOT NULL THEN 'key' WHEN shape = 2 THEN 'pattern' WHEN shape = 6 THEN 'words' ELSE 'none' END AS found FROM k)"


def _any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


ORACLE: dict[str, str] = {
    "reply_extraction": f"WITH {_R}, {_X} SELECT event_id, md5(t) AS digest, length(t) AS size, shape IN (0, 1, 7) AS is_json FROM x",
    "reply_best_block": f"WITH {_R} SELECT event_id, 2::BIGINT AS blocks, score::DOUBLE AS final_score FROM r WHERE shape = 2",
    "reply_repair": f"WITH {_R}, {_K} SELECT event_id, shape IN (0, 1, 7) AS as_sent, readable AS after, k AS final_score FROM k",
    "reply_scores": f"WITH {_R}, {_K}, {_S} SELECT event_id, score, found FROM s",
    "reply_validation": f"WITH {_R}, {_K} SELECT event_id, shape IN (0, 3, 4, 5) AND k <= 10 AS valid, concat_ws('; ', CASE WHEN NOT readable THEN 'unreadable' END, CASE WHEN shape = 7 THEN 'no final_score' END, CASE WHEN shape IN (1, 7) THEN 'no scores' END, CASE WHEN k > 10 THEN 'final_score out of range' END) AS broken, 5.0::DOUBLE AS creativity FROM k",
    "reply_limits": f"WITH {_R}, d AS (SELECT 'document' AS source, doc_id AS id, lower(coalesce(min(text), '')) AS t FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id UNION ALL SELECT 'reply', event_id, lower(reply) FROM r) SELECT source, id, {_any_of('t', QUOTA)} AS quota, {_any_of('t', RATE + FAILED)} AS limited FROM d",
    "reply_status": f"WITH {_R}, {_K}, {_S}, c AS (SELECT event_id, found, greatest(0, least(10, coalesce(score, 0))) AS c FROM s) SELECT event_id, c AS score, round(c * 10, 2) AS percent, CASE WHEN c < 6 THEN 'needs_attention' ELSE 'pass' END AS status, concat_ws(' | ', CASE WHEN found = 'none' THEN 'no score' END, CASE WHEN found IN ('pattern', 'words') THEN 'score from text' END, CASE WHEN c = 0 THEN 'zero' END) AS notes FROM c",
    "provider_fallback": f"WITH {_R}, {_K}, {_S}, v AS (SELECT event_id // 3 AS entity, event_id % 3 AS place, score FROM s WHERE found = 'key' AND score BETWEEN 0.1 AND 10), e AS (SELECT DISTINCT event_id // 3 AS entity FROM r) SELECT e.entity, arg_min(score, place) AS score, min(place)::INT AS provider FROM e LEFT JOIN v ON v.entity = e.entity GROUP BY e.entity",
    "formatter_output": """WITH e AS (SELECT DISTINCT event_id AS i FROM events WHERE event_id IS NOT NULL), c AS (SELECT i, CASE WHEN i % 5 = 0 THEN 0 WHEN i % 5 = 1 THEN 2 ELSE i % 7 END AS u, CASE WHEN i % 5 = 0 THEN 0 ELSE i % 12 END AS f FROM e), r AS (SELECT *, coalesce(round(f * 100.0 / nullif(u + f, 0), 1), 0)::DOUBLE AS ratio FROM c)
SELECT i AS event_id, u::BIGINT AS unformatted, f::BIGINT AS formatted, (u + f)::BIGINT AS total, ratio, CASE WHEN u = 0 AND f > 0 THEN 'perfect' WHEN ratio >= 80 THEN 'good' WHEN ratio >= 50 THEN 'needs_work' WHEN u + f > 0 THEN 'poor' ELSE 'unknown' END AS status FROM r""",
}
