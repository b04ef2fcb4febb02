"""Token counts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default place of the vocabulary; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """Encoder with the byte length of every token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def coder(path: str = VOCABULARY) -> Coder:
    """The encoder of a vocabulary file, loaded once a process."""
    return Coder(path)


def shipped(spark: SparkSession, path: str) -> str:
    """Name under which every worker finds a copy of the driver's vocabulary file (see ``worker_coder``)."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def worker_coder(name: str) -> Coder:
    """The encoder of a shipped vocabulary file, in a task."""
    return coder(SparkFiles.get(name))


def clean_text(text: object) -> str | None:
    """Text with unpaired surrogates replaced, or ``None``."""
    return text.encode("utf-8", "replace").decode() if isinstance(text, str) else None


def source_key(c: Column | str) -> Column:
    """One spelling of a source: lower case, underscores, no outer blanks; null and blank become ``unknown``."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.trim(F.translate(F.lower(F.trim(c)), "- ", "__"))
    return F.when(c != "", c).otherwise("unknown") if c is not None else c


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Size, duplicate cluster and quality of each document: ``doc_id``, ``source``, ``tokens``, ``cluster``, ``quality``.

    One pass over the texts without a shuffle. ``cluster`` is a 63-bit digest of the text without differences in white
    space and byte-order marks: copies share it. ``quality`` is the share of distinct words, at least 0.05, so that
    repetitive texts weigh less. Null, empty and blank texts have no tokens worth placing and are left out.
    """

    name = shipped(documents.sparkSession, vocabulary)

    def measure(batches: Iterator[pd.DataFrame]):
        code = worker_coder(name)
        for pdf in batches:
            kept, tokens, clusters, quality = [], [], [], []
            for i, raw in enumerate(pdf["text"]):
                text = clean_text(raw)
                parts = text.replace("﻿", " ").split() if text else []
                if not parts:
                    continue
                kept.append(i)
                tokens.append(code.count(text))
                digest = hashlib.md5(" ".join(parts).encode()).digest()
                clusters.append(int.from_bytes(digest[:8], "big") >> 1)
                quality.append(max(0.05, len(set(parts)) / len(parts)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[kept].to_numpy(), "source": pdf["source"].iloc[kept].to_numpy(), "tokens": np.array(tokens, np.int64), "cluster": np.array(clusters, np.int64), "quality": np.array(quality, np.float64)})

    rows = documents.select("doc_id", source_key("source").alias("source"), "text").where("doc_id is not null and text is not null")
    return rows.mapInPandas(measure, "doc_id long, source string, tokens long, cluster long, quality double")
