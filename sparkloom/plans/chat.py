"""Conversations: formatting, pairs, hygiene of prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BUGFIX_STARTS, TASK_PHRASES, chat, masked_task, task_kind, trimmed
from ..operators.dedup import keep_first
from ..sources.tables import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, prompt, response: user turns and the assistant turn that follows."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"]).select((F.col("conv_id") * 10_000 + F.col("turn")).alias("idx"), "prompt", "response")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("idx", chat(F.col("prompt"), F.col("response")).alias("formatted"))


def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("role") == "user", F.concat(F.lit("<|user|>\n"), trimmed(F.col("text")), F.lit("\n<|end|>\n<|assistant|>\n"))).when(F.col("role") == "assistant", F.concat(F.col("text"), F.lit("\n<|end|>\n"))).otherwise(F.lit(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "").alias("transcript"))


def example_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(pairs(spark, sf_dir), ["prompt"], "idx").select("idx", "prompt", "response")


def prompt_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: every later copy of a (prompt, response) pair, with the first one."""
    rows = pairs(spark, sf_dir)
    first = rows.groupBy("prompt", "response").agg(F.min("idx").alias("first"))
    return rows.join(first, ["prompt", "response"]).filter("idx > first").select("idx", F.lit("duplicate").alias("reason"), F.col("first").alias("detail"))


def contradiction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("task", masked_task(F.col("prompt")))
    return rows.groupBy("task").agg(F.countDistinct("response").alias("answers"), F.min("idx").alias("first")).select(F.md5("task").alias("task_md5"), "answers", "first")


def task_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = F.element_at(F.array(*[F.lit(p) for p in OPENINGS]), (F.col("idx") % len(OPENINGS) + 1).cast("int"))
    return pairs(spark, sf_dir).select(F.concat(opened, "prompt").alias("prompt")).groupBy(task_kind(F.col("prompt")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def stuck_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role equals that of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("was", F.lag("role").over(w)).filter("role = was").select("conv_id", "turn", "role")


#: The conversations hold no coding tasks; every prompt is given the opening of a template or none.
OPENINGS = ("", *[p + " " for phrases in TASK_PHRASES.values() for p in phrases], *[p + " " for p in BUGFIX_STARTS])

QUERIES = {f.__name__: f for f in (chat_format, chat_transcript, example_pairs, prompt_dedup_pairs, contradiction_audit, task_kinds, stuck_turns)}
_PAIRS = "WITH pairs AS (SELECT u.conv_id * 10000 + u.turn AS idx, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user') "
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "chat_format": _PAIRS + f"SELECT idx, '<|user|>' || chr(10) || {_TRIM.format('prompt')} || chr(10) || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || {_TRIM.format('response')} || chr(10) || '<|end|>' AS formatted FROM pairs",
    "chat_transcript": f"SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<|user|>' || chr(10) || {_TRIM.format('text')} || chr(10) || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) WHEN 'assistant' THEN text || chr(10) || '<|end|>' || chr(10) ELSE '' END, '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    "example_pairs": _PAIRS + "SELECT idx, prompt, response FROM pairs QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY idx) = 1",
    "prompt_dedup_pairs": _PAIRS + ", f AS (SELECT *, min(idx) OVER (PARTITION BY prompt, response) AS first FROM pairs) SELECT idx, 'duplicate' AS reason, first AS detail FROM f WHERE idx > first",
    "contradiction_audit": _PAIRS + ", t AS (SELECT *, regexp_replace(prompt, '`[A-Za-z_]\\w*([(`])', '`F\\1', 'g') AS task FROM pairs) SELECT md5(task) AS task_md5, count(DISTINCT response) AS answers, min(idx) AS first FROM t GROUP BY task",
    "task_kinds": _PAIRS + ", prompts AS (SELECT ([" + ", ".join(f"'{p}'" for p in OPENINGS) + f"])[idx % {len(OPENINGS)} + 1] || prompt AS prompt FROM pairs) SELECT CASE " + " ".join(f"WHEN {' OR '.join(f"contains(prompt, '{p}')" for p in phrases)} THEN '{kind}'" for kind, phrases in TASK_PHRASES.items()) + " " + " ".join(f"WHEN starts_with(prompt, '{p}') THEN 'bugfix'" for p in BUGFIX_STARTS) + " ELSE 'write' END AS kind, count(*) AS n FROM prompts GROUP BY 1",
    "stuck_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn)",
}
