"""Token counts by public tokenizers: batches balanced by bytes, long texts split where no token can cross, lengths only."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.words import pieces

#: Everything that any Unicode version or library counts as white space.
SPACES = "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F),
    (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
))
#: Where the rules of byte-level BPE always begin a new word: a space or line feed after something else, and between ASCII
#: letters and digits. Such a rule looks only ahead, so both sides are cut into the same words as the whole.
BOUNDARY = rf"[^{SPACES}](?=[ \n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
#: Fixed value: the public word rule of such vocabularies, for files that hold none.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cut(text: str, boundary: re.Pattern | None, size: int) -> Iterator[str]:
    """The text in parts of at least `size` characters (but the last) that begin at a boundary; whole where there is none."""
    begin = 0
    while boundary and len(text) - begin > size:
        found = boundary.search(text, begin + size - 1)
        if not found:
            break
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


def json_boundary(settings: dict) -> re.Pattern | None:
    """The safe boundary of a tokenizer in a JSON file; None for rules under which a part may be encoded differently."""
    rule = settings.get("pre_tokenizer") or {}
    by_bytes = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    extra = settings.get("added_tokens") or []
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and not re.search(BOUNDARY, t["content"]) for t in extra)
    return re.compile(BOUNDARY) if by_bytes and plain and not settings.get("normalizer") else None


def encoder(name: str, data: bytes, pattern: str = WORDS) -> tuple[Callable[[list[str]], list[int]], re.Pattern | None]:
    """A function from texts to numbers of tokens, and the boundary at which texts may be split.

    `.json` is read by tokenizers, `.model` by sentencepiece, `.tiktoken` (ranks) by tiktoken with the word rule
    `pattern`. No token is added; special strings inside a text are what the library makes of them by default.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of a task are Spark's
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        known = Tokenizer.from_buffer(data)
        known.no_truncation()
        known.no_padding()
        return lambda texts: [len(e) for e in known.encode_batch_fast(texts, add_special_tokens=False)], json_boundary(json.loads(data))
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], None
    if name.endswith(".tiktoken"):
        from tiktoken import Encoding

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        ranked = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ranked.encode_ordinary(t)) for t in texts], re.compile(BOUNDARY) if pattern == WORDS else None
    raise ValueError(f"no library is known for {name}")


def lengths(texts: Iterator[str], encode: Callable, boundary: re.Pattern | None, batch_bytes: int, part_chars: int) -> np.ndarray:
    """Number of tokens of each text. Parts of texts are encoded in batches of about `batch_bytes`, in the order of the texts."""
    total, parts, owner, size = [], [], [], 0

    def flush() -> None:
        for i, n in zip(owner, encode(parts), strict=True):
            total[i] += n

    for i, text in enumerate(texts):
        total.append(0)
        for part in cut(text, boundary, part_chars):
            parts.append(part)
            owner.append(i)
            size += len(part.encode())
            if size >= batch_bytes:
                flush()
                parts, owner, size = [], [], 0
    if parts:
        flush()
    return np.array(total, np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512, batch_bytes: int = 1 << 18, part_chars: int = 1 << 16, pattern: str = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for every row, by the tokenizer in the file `path`.

    A null text counts as an empty one and an empty text has no tokens (sentencepiece and tokenizers agree on that); ids
    are passed through, null or repeated, and other columns are ignored. A very long text is encoded in parts; one without
    any safe boundary is a single part, as whole texts are for tokenizers whose rules are not known to be safe. An empty
    table gives no rows. Nothing is shuffled: scan tasks are equal in bytes already, and batches inside them are filled by
    bytes, so that neither many short nor a few long texts decide how much memory a call takes. The file, which does
    not grow with the data, is read once by the driver, so executors need no copy.
    """
    spark = docs.sparkSession
    name = Path(path).name
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())  # a vocabulary: fixed, some MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, boundary = encoder(name, shared.value, pattern)
        for piece in pieces(batches, 4 * batch_bytes):
            text = piece.column("text")
            n = lengths((t.as_py() for t in text), encode, boundary, batch_bytes, part_chars)
            size = pa.compute.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
