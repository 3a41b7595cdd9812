"""Token counts of whole texts with a public tokenizer, encoded in batches inside Arrow functions.

Only lengths leave the workers. Texts of any length are split where the tokenizer surely
splits them: at ASCII white space if its pre-tokenizer drops white space, before ASCII
white space that follows another character if it keeps white space with what comes after
it (byte-level vocabularies). No token, normalisation or special string reaches across.
The distinct pieces that a worker has not met are encoded in batches of about
`BATCH_BYTES`, and a text's count is the sum over its pieces. `CACHE_PIECES` and
`CACHE_BYTES` bound what a worker remembers; they change speed only. For other tokenizers
and .model files texts are encoded whole, in batches of the same size.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text without a safe
boundary is encoded in one piece; repeated rows are counted like others; an empty
table gives no rows; further columns of the input are passed through.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 18
CACHE_PIECES, CACHE_BYTES = 500_000, 64 << 20


def batches_of(texts: list, size: int = BATCH_BYTES) -> Iterator[list]:
    """texts in lists of about `size` characters or bytes each, at least one text."""
    batch, held = [], 0
    for text in texts:
        batch.append(text)
        held += len(text) + 16
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


#: How a tokenizer treats white space: drops it, or keeps it with what follows.
DROPS, KEEPS, UNKNOWN = "drops", "keeps", "unknown"
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\n\x0b\x0c\r])")
_LOCAL_NORMALIZERS = ("NFC", "Lowercase")


def treatment(spec: dict) -> str:
    """What a tokenizers file does with white space, from its own normalizer and pre-tokenizer."""

    def parts(x: dict | None, name: str) -> list[dict]:
        return [] if x is None else x[name] if x["type"] == "Sequence" else [x]

    normal, first = parts(spec.get("normalizer"), "normalizers"), (parts(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")) or any(set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in spec.get("added_tokens", [])):
        return UNKNOWN
    spaces_only = all(n["type"] in _LOCAL_NORMALIZERS or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normal)
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"] and spaces_only:
        import regex

        keeps = regex.compile(first["pattern"]["Regex"])
        return UNKNOWN if any(keeps.search(x) for x in (" ", "\t\n", " \x0b\x0c\r ")) or any(" " in m for m in keeps.findall("a b ' s . ,")) else DROPS
    if first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not normal:
        return KEEPS
    return UNKNOWN


class Counter:
    """Counts tokens of texts: .json files with tokenizers, .model files with sentencepiece, .tiktoken files with tiktoken."""

    def __init__(self, path: str):
        self.known, self.held = {}, 0
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            fast = getattr(t, "encode_batch_fast", t.encode_batch)
            with open(path, encoding="utf-8") as f:
                self.kind = treatment(json.load(f))
            self.lengths = lambda texts: [len(e) for e in fast(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.kind = KEEPS
            self.lengths = lambda texts: [len(e.encode_ordinary(t)) for t in texts]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.kind = UNKNOWN
            self.lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]

    def pieces(self, text: bytes) -> list:
        """A text's pieces, for lengths(); bytes where it is split at ASCII white space."""
        return text.split() if self.kind == DROPS else _BEFORE_SPACE.split(text.decode())

    def count(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each UTF-8 text."""
        if self.kind == UNKNOWN:
            return [n for batch in batches_of([(t or b"").decode() for t in texts]) for n in self.lengths(batch)]
        out: list[int] = []
        for batch in batches_of([t or b"" for t in texts], 16 * BATCH_BYTES):
            split = [self.pieces(t) for t in batch]
            new = list(set().union(*split).difference(self.known))
            size = sum(map(len, new))
            if len(self.known) + len(new) > CACHE_PIECES or self.held + size > CACHE_BYTES:
                new = list(set().union(*split))
                self.known, self.held, size = {}, 0, sum(map(len, new))
            for part in batches_of(new):
                self.known.update(zip(part, self.lengths([x.decode() for x in part] if self.kind == DROPS else part), strict=True))
            self.held += size
            out += [sum(map(self.known.__getitem__, x)) for x in split]
        return out


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """docs without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    tokenizer: the name of a vocabulary file of the public tokenizers, or a path that
    every executor can open.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    frame = docs.select(*rest, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("__codeloom_text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        counter = Counter(path)
        for batch in batches:
            n = counter.count(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return frame.mapInArrow(encode, schema).withColumn("over_limit", F.col("n_tokens") > limit)
