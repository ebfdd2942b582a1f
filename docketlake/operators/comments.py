"""The author's own comments on a post, with what they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import filled, strip
from docketlake.schema import COMMENT_CHARS, COMMENT_SEPARATOR, WITHDRAWN


def comment_id(reference: Column) -> Column:
    """The id in a reference like t1_x."""
    return F.regexp_replace(F.nullif(reference, F.lit("")), "^[^_]*_", "")


def op_comments(posts: DataFrame, comments: DataFrame, cap: int = COMMENT_CHARS) -> DataFrame:
    """(id, op_comments): by time, each as "OP comment: ..." or with the comment it answers, cut at ``cap`` characters.

    Comments by others, withdrawn and empty ones are left out. Posts without an
    author or without such comments get an empty text.
    """
    body = strip(filled(F.col("body")))
    said = comments.withColumns({"body": body, "said": (body != "") & ~body.isin(*WITHDRAWN)})
    own = said.alias("c").join(posts.filter(filled(F.col("author")) != "").select(F.col("id").alias("post_id"), F.col("author").alias("op")), "post_id").filter((F.col("c.author") == F.col("op")) & F.col("said"))
    parents = said.filter("said").select(F.col("post_id").alias("p_post"), F.col("id").alias("p_id"), F.col("author").alias("p_author"), F.col("body").alias("p_body"))
    up = comment_id(F.col("parent_id"))
    joined = own.join(parents, (F.col("post_id") == F.col("p_post")) & (up == F.col("p_id")) & (up != F.col("post_id")), "left")
    answer = F.concat(F.lit("Parent comment ("), F.coalesce(F.nullif("p_author", F.lit("")), F.lit("commenter")), F.lit("): "), F.col("p_body"), F.lit("\nOP reply: "), F.col("c.body"))
    line = F.when(F.col("p_body").isNotNull(), answer).otherwise(F.concat(F.lit("OP comment: "), F.col("c.body")))
    gathered = joined.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct(F.col("c.created_utc"), F.col("c.id"), line.alias("line")))).alias("all"))
    text = F.left(F.array_join(F.transform("all", lambda x: x["line"]), COMMENT_SEPARATOR), F.lit(cap))
    return posts.select("id").join(gathered.select(F.col("post_id").alias("id"), text.alias("op_comments")), "id", "left").select("id", filled(F.col("op_comments")).alias("op_comments"))


def needs_refresh(text: Column) -> Column:
    """Whether gathered comments lack the context that later versions add."""
    return F.coalesce((text != "") & ~F.contains(text, F.lit("OP comment:")) & ~F.contains(text, F.lit("Parent comment (")), F.lit(False))
