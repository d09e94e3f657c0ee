"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# --- fixed values ---
#: How byte-level BPE vocabularies of this kind split text before merging (contractions, words, numbers, signs, blanks).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values ---
#: Bracketed remarks of others inside a speech; they are read but not learned.
REMARK = re.compile(rb"\([^()\n]*\)|\[[^\[\]\n]*\]")

_LOADED: dict[str, object] = {}
_LENGTHS: dict[str, np.ndarray] = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, loaded once per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[vocabulary] = tiktoken.Encoding("local", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def _token_bytes(vocabulary: str) -> np.ndarray:
    """Bytes of each token, by rank."""
    if vocabulary not in _LENGTHS:
        known = encoder(vocabulary)
        lengths = np.zeros(known.n_vocab, np.int64)
        for rank in range(known.n_vocab):
            try:
                lengths[rank] = len(known.decode_single_token_bytes(rank))
            except KeyError:  # a rank without a token
                pass
        _LENGTHS[vocabulary] = lengths
    return _LENGTHS[vocabulary]


def quiet_runs(text: str, tokens: list[int], lengths: np.ndarray) -> list[int]:
    """First token and number of tokens, one run after the other, of the remarks: tokens whose last byte lies in one."""
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in REMARK.finditer(raw)] if b"(" in raw or b"[" in raw else []
    if not spans:
        return []
    ends = np.cumsum(lengths[tokens])
    first, last = (np.searchsorted(ends, [s[i] for s in spans], "right") for i in (0, 1))
    return [int(x) for a, b in zip(first, last) if b > a for x in (a, b - a)]


def count_tokens(df: DataFrame, column: str, vocabulary: str = DEFAULT_VOCABULARY, learned: str | None = None) -> DataFrame:
    """``df`` without ``column`` but with ``tokens``, ``loss_tokens`` (longs) and ``quiet`` (array of longs).

    Whole texts are encoded; null and empty texts have 0 tokens.  Tokens that bear no loss are those of bracketed remarks
    and, with ``learned`` (a boolean column, which is dropped), all tokens of rows where it is not true.  ``quiet`` says
    where they stand: first token and number of tokens of each run.  Other columns are kept; those already called as the
    new ones are replaced.
    """
    new = ("tokens", "loss_tokens", "quiet")
    rest = [c for c in df.columns if c not in (column, learned, *new)]
    rows = df.select(*rest, column, *([learned] if learned else []))
    added = [T.StructField("tokens", T.LongType()), T.StructField("loss_tokens", T.LongType()), T.StructField("quiet", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(rows.schema[c] for c in rest), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(vocabulary).encode_ordinary, _token_bytes(vocabulary)
        for batch in batches:
            tokens, loss, quiet = [], [], []
            wanted = batch.column(len(rest) + 1).to_pylist() if learned else [True] * batch.num_rows
            for text, bears in zip(batch.column(len(rest)).to_pylist(), wanted):
                found = encode(text) if text else []
                runs = quiet_runs(text, found, lengths) if found and bears else [0, len(found)] if found else []
                tokens.append(len(found))
                loss.append(len(found) - sum(runs[1::2]))
                quiet.append(runs)
            made = [pa.array(tokens, pa.int64()), pa.array(loss, pa.int64()), pa.array(quiet, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=schema.names)

    return rows.mapInArrow(run, schema)
