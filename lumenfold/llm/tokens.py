"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary: byte-level BPE ranks; never copied into the repository.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of that vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LOADED: dict = {}


def encoder(path: str):
    """Tokenizer of a vocabulary file, loaded once per worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(texts, path: str) -> list[int]:
    enc = encoder(path)
    out: list[int] = []
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size > 1 << 20:
            out.extend(len(x) for x in map(enc.encode_ordinary, group))
            group, size = [], 0
    out.extend(len(x) for x in map(enc.encode_ordinary, group))
    return out


def token_sizes(documents: DataFrame, keep: tuple[str, ...] = (), path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, *keep, tokens): null and empty texts have 0 tokens, documents
    without an id take no part."""
    schema = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))

    def run(batches):
        for pdf in batches:
            out = pdf[["doc_id", *keep]].copy()
            out["tokens"] = pd.Series(count_tokens(pdf["text"].tolist(), path), dtype="int64", index=out.index)
            yield out

    return documents.filter("doc_id is not null").select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"{schema}, tokens long")
