"""Workload generation: prompts, lengths and request lines from a text corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import small_side


def conversation_pairs(
    df: DataFrame,
    conversation: str = "conversation_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    user_role: str = "human",
) -> DataFrame:
    """(system, user) prompt per conversation.

    The user prompt is the first user message that is not empty, the system prompt the first
    non-empty system message before it. Conversations of fewer than two messages, or without
    a user message, give no row. Three aggregates per conversation, combined before the
    shuffle, so a conversation of any length is fine.
    """
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    pair = F.struct(F.col(turn).alias("at"), F.col(text).alias("text"))
    firsts = df.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(F.when((F.col(role) == "system") & filled, pair)).alias("__s"),
        F.min(F.when((F.col(role) == user_role) & filled, pair)).alias("__u"),
    )
    system = F.when(F.col("__s.at") < F.col("__u.at"), F.col("__s.text"))
    return firsts.filter("__n >= 2 AND __u IS NOT NULL").select(
        conversation,
        F.coalesce(system, F.lit(V.DEFAULT_SYSTEM_PROMPT)).alias("system_prompt"),
        F.col("__u.text").alias("user_prompt"),
    )


def uniform(seed, index, salt: str) -> Column:
    """Uniform number in (0, 1) that depends only on seed, row index and salt.

    Unlike a per-partition generator it gives the same rows after a retry or repartition.
    """
    text = F.concat_ws(":", F.lit(salt), S.as_col(seed).cast("string"), S.as_col(index).cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def sample_length(
    distribution: str, mean: float, stdev: float, seed, index, salt: str, min_val: int = 1, max_val: int | None = None
) -> Column:
    """Positive length per row: fixed, lognormal, normal or uniform; rounded, then clamped."""
    u1, u2 = uniform(seed, index, salt + "a"), uniform(seed, index, salt + "b")
    gauss = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
    if distribution == "fixed":
        return F.lit(int(mean)).cast("long")
    if distribution == "lognormal":
        sigma2 = math.log(1 + stdev**2 / mean**2)
        value = F.exp(F.lit(math.log(mean) - sigma2 / 2) + F.lit(math.sqrt(sigma2)) * gauss)
    elif distribution == "normal":
        value = F.lit(float(mean)) + F.lit(float(stdev)) * gauss
    elif distribution == "uniform":
        low = max(min_val, mean - stdev)
        value = F.lit(float(low)) + F.lit(float(mean + stdev - low)) * u1
    else:
        value = F.lit(float(mean))
    length = F.greatest(F.lit(min_val).cast("long"), F.rint(value).cast("long"))
    return length if max_val is None else F.least(length, F.lit(max_val).cast("long"))


def synthetic_prompt(words, offset) -> Column:
    """A prompt of `words` words cycled from the fixed list, starting at `offset`."""
    table = F.array(*[F.lit(w) for w in V.SYNTHETIC_WORDS])
    size = len(V.SYNTHETIC_WORDS)
    n, start = S.as_col(words), S.as_col(offset)
    picked = F.transform(
        F.sequence(F.lit(1).cast("long"), n), lambda i: F.element_at(table, ((i - 1 + start) % size + 1).cast("int"))
    )
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(picked, " "))


def zero_padded(number, width: int) -> Column:
    """At least `width` digits; longer numbers are kept whole."""
    digits = S.as_col(number).cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def persona_prompt(number, text, target_tokens: int) -> Column:
    """`[Persona 007] ...`: a system prompt of at most four characters per token."""
    tagged = F.concat(F.lit("[Persona "), zero_padded(number, 3), F.lit("] "), S.as_col(text))
    return F.trim(F.substring(tagged, 1, target_tokens * 4))


def system_prompts(corpus: DataFrame, number: str, text: str, count: int, target_tokens: int) -> DataFrame:
    """The first `count` corpus rows in the order of (number, text), numbered from 0 as personas.

    Rows without a number or text are passed over; a shorter corpus gives fewer personas.
    """
    usable = corpus.filter(F.col(number).isNotNull() & F.col(text).isNotNull()).select(number, text)
    # At most `count` rows are left to number.
    first = usable.orderBy(number, text).limit(count)
    nth = (F.row_number().over(W.orderBy(number, text)) - 1).cast("long")
    numbered = first.select(nth.alias("persona"), text)
    return numbered.select("persona", persona_prompt("persona", text, target_tokens).alias("system_prompt"))


def generate_requests(
    rows: DataFrame,
    index: str,
    model: str,
    prefix: str = "req",
    seed: int = 42,
    personas: DataFrame | None = None,
    input_length: tuple = ("lognormal", 1500, 1200, 4096),
    output_length: tuple = ("lognormal", 500, 400, 2048),
    text: str | None = None,
) -> DataFrame:
    """One request per row of `rows`, numbered by `index`.

    Source of the user prompt: the column `text` cut to four characters per sampled token,
    or synthetic words when `text` is None; a `user_prompt` column of the input (from
    conversations) is kept as it is. System prompts are taken round robin from `personas`
    (numbered from 0, see `system_prompts`), which is broadcast if its counted size allows.
    """
    i = F.col(index).cast("long")
    dist, mean, stdev, top = input_length
    tokens = sample_length(dist, mean, stdev, F.lit(seed), i, "in", 16, top)
    out = sample_length(*output_length[:3], F.lit(seed), i, "out", 1, output_length[3])
    df = rows
    if personas is not None and "system_prompt" not in rows.columns:
        known = max(1, personas.count())
        df = df.withColumn("persona", F.pmod(i, F.lit(known))).join(small_side(personas), "persona", "left")
    elif "system_prompt" not in rows.columns:
        df = df.withColumn("system_prompt", F.lit(""))
    if "user_prompt" in rows.columns:
        user = F.col("user_prompt")
    elif text:
        user = F.trim(F.substring(F.col(text), F.lit(1), (tokens * 4).cast("int")))
    else:
        user = synthetic_prompt(tokens, F.floor(uniform(F.lit(seed), i, "words") * len(V.SYNTHETIC_WORDS)))
    return df.select(
        i.alias("line_no"),
        F.concat(F.lit(f"{prefix}-"), zero_padded(i, 4)).alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"),
        F.lit(model).alias("model"),
        out.alias("max_tokens"),
        F.coalesce("system_prompt", F.lit("")).alias("system_prompt"),
        user.alias("user_prompt"),
    )


def generate_jobs(rows: DataFrame, index: str, model: str, seed: int = 42, **options) -> DataFrame:
    """The three load-test jobs: same rows, seeds +0/+1/+2, their own windows and id prefixes."""
    parts = []
    for n, (job, _, window, _) in enumerate(V.JOB_WINDOWS):
        one = generate_requests(rows, index, model, job, seed + n, **options)
        parts.append(one.withColumns({"job_id": F.lit(job), "completion_window": F.lit(window)}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
