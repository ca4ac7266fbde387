"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from headway.llm.common import slices

#: One blank between two visible characters.  The piece vocabulary never continues a piece over a blank,
#: and each encoded part gets the same leading blank mark that the blank would have become.
_BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def split_text(text: str, limit: int) -> list[str]:
    """Cut ``text`` into parts of about ``limit`` characters at safe boundaries, dropping the blank at each cut.

    A stretch without a safe boundary stays whole, however long it is.
    """
    parts, start = [], 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def balanced(parts: list[tuple[int, str]], batch_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Group (row, part) into batches of about ``batch_bytes`` bytes of UTF-8 each."""
    batch, size = [], 0
    for part in parts:
        batch.append(part)
        size += len(part[1].encode())
        if size >= batch_bytes:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def safe_to_split(sp) -> bool:
    """Whether no piece of the vocabulary holds a blank mark after another character."""
    return not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))


def count_tokens(
    df: DataFrame,
    model_path: str,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    limit: int = 4096,
    split_chars: int = 16_384,
    batch_bytes: int = 262_144,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``df``, one row out for each row in.

    The tokenizer file (sentencepiece ``.model`` or tokenizers ``.json``) is read once on the driver and travels
    with the task, so executors need no copy of it; its size is that of a vocabulary, whatever the input.
    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows give repeated results, other columns are
    ignored.  Only one part of an Arrow batch is worked on at a time, and each call of the library gets ``batch_bytes``.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    is_json = model_path.endswith(".json")

    def encoder():
        if is_json:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(model.decode())
            t.no_truncation()
            t.no_padding()
            return False, lambda texts: [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return safe_to_split(sp), lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, lengths = encoder()
        for b in (part for whole in batches for part in slices(whole, 1)):
            texts = b.column(1)
            n_bytes, n_tokens = [0] * len(texts), [0] * len(texts)
            parts = []
            for row, text in enumerate(texts.to_pylist()):
                if text:
                    n_bytes[row] = len(text.encode())
                    parts += [(row, p) for p in (split_text(text, split_chars) if splits else [text])]
            for batch in balanced(parts, batch_bytes):
                for (row, _), n in zip(batch, lengths([p for _, p in batch]), strict=True):
                    n_tokens[row] += n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = df.select(id_col, text_col)
    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
