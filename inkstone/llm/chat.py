"""Operator 8, chat formatting: token ids of whole conversations with a training mask aligned by offsets.

A conversation is gathered, rendered once by the template, and encoded once with offsets. Turns give sorted spans of
characters; a token's span is intersected with them by binary search. Encoding turns by themselves would split tokens
that the whole text joins, and counting tokens by turn would lose those at the borders.

The shuffle gathers a conversation's turns, nothing else; a conversation has to fit a task, as it has to fit a model.
The tokenizer's file is a parameter and is read where it lies.

Defined results: turns come by (turn, role, text), nulls first; a null or unknown role is rendered as ``unknown`` and
never trained on; a null text is empty. Rows without a conversation's id belong to none and are left out. Repeated rows
are repeated turns. A token is trained on if any of its characters lies in the content of an assistant's turn or in the
marker that ends it; a token without characters is not. Text that looks like a marker is ordinary text. Very long turns
are encoded whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ROLES = ("system", "user", "assistant", "tool")
END = "<|end|>\n"
SCHEMA = "conv_id bigint, n_tokens int, n_trained int, token_ids array<int>, mask array<tinyint>"


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, np.ndarray]:
    """The text of a conversation of (role, text) and the spans of it that are trained on, sorted and disjoint."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"<|{role if role in ROLES else 'unknown'}|>\n"
        body = (text or "") + END
        parts += [head, body]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token span, whether it shares a character with one of the sorted, disjoint spans."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), np.int8)
    start, end = offsets[:, 0], offsets[:, 1]
    nth = np.searchsorted(spans[:, 1], start, side="right")  # the first span that ends after the token starts
    inside = nth < len(spans)
    return (inside & (start < end) & (spans[np.minimum(nth, len(spans) - 1), 0] < end)).astype(np.int8)


@lru_cache(maxsize=4)
def tokenizer(path: str):  # noqa: ANN201
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def format_chats(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``conv_id, n_tokens, n_trained, token_ids, mask`` of every conversation of (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # a bounded number of encodings at a time
                part = batch.slice(i, 64)
                rendered = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                codes = encoder.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                masks = [mask(np.array(c.offsets, np.int64).reshape(-1, 2), r[1]) for c, r in zip(codes, rendered)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"),
                        pa.array([len(c.ids) for c in codes], pa.int32()),
                        pa.array([int(m.sum()) for m in masks], pa.int32()),
                        pa.array([c.ids for c in codes], pa.list_(pa.int32())),
                        pa.array([m.tolist() for m in masks], pa.list_(pa.int8())),
                    ],
                    ["conv_id", "n_tokens", "n_trained", "token_ids", "mask"],
                )

    return whole.mapInArrow(run, SCHEMA)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
