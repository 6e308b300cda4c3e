"""Answer generation behind a provider: ``generate(prompts: list[str], max_tokens: list[int]) -> list[str]``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from longspan.sources.tables import slices

_QUESTION = re.compile(r"Question:\s*(.*?)\s*(?:\n|$)")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")


class Generator(Protocol):
    def generate(self, prompts: list[str], max_tokens: list[int]) -> list[str]: ...


class ExtractiveGenerator:
    """Default without a model: the sentence of the prompt that shares the most words with its question, cut to the limit; ties to the first."""

    def generate(self, prompts: list[str], max_tokens: list[int]) -> list[str]:
        out = []
        for p, n in zip(prompts, max_tokens, strict=True):
            asked = _QUESTION.search(p)
            q = set(re.findall(r"\w+", asked[1].lower())) if asked else set()
            body = p[: asked.start()] if asked else p
            best = max(_SENTENCE.findall(body) or [""], key=lambda s: len(q & set(re.findall(r"\w+", s.lower()))))
            out.append(" ".join(best.split()[: max(n, 0)]))
        return out


def generate(prompts: DataFrame, key: list[str], make: Callable[[], Generator] = ExtractiveGenerator) -> DataFrame:
    """``key..., generated_str, generated_ntokens, purely_generated_str, purely_generated_ntokens, elapsed_time`` of rows with ``prompt`` and ``max_gen_len``.

    One provider a task, one call for each part of a batch; its time is shared by its rows. Null prompts generate nothing.
    """
    import time

    kinds = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        n = len(key)
        for b in slices(batches):
            asked = [p or "" for p in b.column(n).to_pylist()]
            began = time.perf_counter()
            texts = provider.generate(asked, [x or 0 for x in b.column(n + 1).to_pylist()])
            each = (time.perf_counter() - began) / max(1, len(texts))
            full = [p + t for p, t in zip(asked, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(n)], pa.array(full, pa.string()), pa.array([len(x.split()) for x in full], pa.int32()), pa.array(texts, pa.string()), pa.array([len(x.split()) for x in texts], pa.int32()), pa.array([each] * len(texts), pa.float64())],
                names=[*key, "generated_str", "generated_ntokens", "purely_generated_str", "purely_generated_ntokens", "elapsed_time"],
            )

    return prompts.select(*key, "prompt", "max_gen_len").mapInArrow(run, f"{kinds}, generated_str string, generated_ntokens int, purely_generated_str string, purely_generated_ntokens int, elapsed_time double")
