"""Columns that need a tokenizer's vocabulary, read from a file the caller names."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Tokens around a message for its header, and tokens kept free for the notice behind a cut text.
HEADER, RESERVE = 2, 30
NOTICE = "\n...\nExecution output is too long and is not fully shown."


@lru_cache(maxsize=2)
def _loaded(vocabulary: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(vocabulary)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def _encoded(vocabulary: str, texts: pd.Series):
    return _loaded(vocabulary).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)


def token_count(spark: SparkSession, path: str):
    """A function from a text column to its number of tokens (null: 0); the file of a few MB goes to executors once."""
    vocabulary = spark.sparkContext.broadcast(Path(path).read_text())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e) for e in _encoded(vocabulary.value, texts)], dtype="int64")

    return count


def message_size(spark: SparkSession, path: str, role: Column, text: Column) -> Column:
    """Tokens of a message: its text, its role, the blank line between them, and two of its header."""
    count = token_count(spark, path)
    blank = len(_encoded(Path(path).read_text(), pd.Series(["\n\n"]))[0])
    return count(text) + count(role) + F.lit(blank + HEADER)


def cut_to_tokens(spark: SparkSession, path: str, text: Column, most: int, at_break: bool = True) -> Column:
    """A text of more than ``most`` less ``RESERVE`` tokens cut there, at its last line break, else space, and a notice.

    Shorter texts stay, null stays null, and a text without a break is cut at the token.
    """
    vocabulary, kept = spark.sparkContext.broadcast(Path(path).read_text()), max(0, most - RESERVE)

    def cut(text: str | None, encoded) -> str | None:
        if text is None or len(encoded) <= kept:
            return text
        end = encoded.offsets[kept - 1][1] if kept else 0
        places = [text.rfind(c, 0, end) for c in "\n "] if at_break else []
        return text[: next((p for p in places if p >= 0), end)] + NOTICE

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(None if pd.isna(t) else t, e) for t, e in zip(texts, _encoded(vocabulary.value, texts))], dtype="object")

    return run(text)
