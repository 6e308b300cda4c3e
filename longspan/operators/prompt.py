"""Prompts: template filling, chat wrapping, query suffixes and deferred requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = "Read the text and answer briefly.\n\nText: {context}\n\nQuestion: {input}\nAnswer:"


def fill(template: str, **columns: Column) -> Column:
    """Concatenates the template's own parts with the columns, so a value that holds a placeholder is not filled again."""
    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[columns[p[1:-1]] if p[:1] == "{" and p[1:-1] in columns else F.lit(p) for p in parts if p])


def fill_by_dataset(rows: DataFrame, templates: dict[str, str], ds_col: str = "ds_name", default: str = DEFAULT_TEMPLATE, **columns: Column) -> Column:
    """The template of each row's dataset; a bounded choice of literals, not a join."""
    out: Column | None = None
    for name, t in sorted(templates.items()):
        cond, value = F.col(ds_col) == name, fill(t, **columns)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return fill(default, **columns) if out is None else out.otherwise(fill(default, **columns))


def augment(retrieved: Column, question: Column, template: str = DEFAULT_TEMPLATE, concat_str: str = "\n") -> Column:
    """Prompt from an array of retrieved pieces; null where nothing was retrieved."""
    return F.when(F.size(retrieved) > 0, fill(template, context=F.array_join(retrieved, concat_str), input=question))


def chat_wrap(content: Column, prefix: str | Column = "[INST] ", suffix: str | Column = " [/INST]") -> Column:
    """One user turn in a model's chat frame."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, content, F.lit(suffix) if isinstance(suffix, str) else suffix)


def query_text(query: Column | None, how: str, prompt: str = "") -> Column:
    """Text whose attention is read: ``last_token`` or ``append_prompt``, with or without a question."""
    if how not in ("last_token", "append_prompt"):
        raise ValueError(f"no query kind named {how!r}")
    if query is None:
        return F.lit(prompt if how == "append_prompt" else "")
    return F.concat(F.lit(prompt), query, F.lit("\n\nAnswer: ")) if how == "append_prompt" else query


def deferred_requests(prompts: DataFrame) -> DataFrame:
    """Generation put off: the prompt stands for the text, with no tokens counted."""
    return prompts.select(
        "*",
        F.col("prompt").alias("generated_str"),
        F.lit(-1).alias("generated_ntokens"),
        F.lit("").alias("purely_generated_str"),
        F.lit(0).alias("purely_generated_ntokens"),
    )
