"""Judge prompts, reply parsing and score means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import JUDGE_MAX_SCORE, JUDGE_SYSTEM_PROMPT, JUDGE_USER_TEMPLATE


# E16 ------------------------------------------------------------------------
def judge_prompt(keyword, text, template: str = JUDGE_USER_TEMPLATE) -> Column:
    """The user template with ``{KEYWORD}`` then ``{WIKITEXT}`` replaced (in
    that order, as two plain replacements)."""
    step = F.replace(F.lit(template), F.lit("{KEYWORD}"), T._c(keyword))
    return F.replace(step, F.lit("{WIKITEXT}"), T._c(text))


def judge_messages(keyword, text) -> Column:
    """The judge's request: its instructions and the text to judge."""
    from .shaping import messages
    return messages(F.lit(JUDGE_SYSTEM_PROMPT), judge_prompt(keyword, text))


# E17 ------------------------------------------------------------------------
def parse_scores(reply) -> Column:
    """The first three integers of the reply; a value above 5 counts 0; fewer
    than three integers (or no reply) gives ``[0, 0, 0]``."""
    nums = F.slice(F.regexp_extract_all(F.coalesce(T._c(reply), F.lit("")), F.lit("([0-9]+)"), 1), 1, 3)
    # a number too long for BIGINT is above the maximum too
    vals = F.transform(nums, lambda x: F.when(
        x.try_cast("bigint") <= JUDGE_MAX_SCORE, x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(nums) == 3, vals).otherwise(
        F.array(*[F.lit(0).cast("bigint")] * 3))


# E18 ------------------------------------------------------------------------
def score_means(df: DataFrame, col: str = "score") -> DataFrame:
    s = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  T.round6(F.avg(s[0])).alias("fluency"),
                  T.round6(F.avg(s[1])).alias("informativeness"),
                  T.round6(F.avg(s[2])).alias("faithfulness"))
