"""Token counts (operator 1): lengths of batch encodings, computed in Arrow functions.

``token_counts`` sends whole texts to the tokenizer in batches of about equal bytes and returns lengths
only.  Long texts are split where no token can span the cut, so the parts' counts add up to the count of
the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from wayring.llm._words import slices, released

#: Bytes of text for one call of the tokenizer.
BATCH_BYTES = 1 << 20
#: Texts beyond this many characters are split.
SPLIT_CHARS = 1 << 15


@lru_cache(maxsize=4)
def _pieces(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=4)
def _words(model: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(model)


def safe_parts(text: str, most: int = SPLIT_CHARS) -> list[str]:
    """Cut before single words so that the parts' token counts add up.

    A part ends before a space that follows a character that is neither white space nor the piece
    vocabulary's space mark; that space is dropped since the encoder puts one before each part.  No piece of
    the vocabulary has a space mark behind another character, so no merge crosses such a cut.
    """
    parts, start = [], 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at > 0 and (text[at - 1].isspace() or text[at - 1] == "▁"):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def encoded_lengths(texts: list[str], model: str, batch_bytes: int = BATCH_BYTES, split_chars: int = SPLIT_CHARS) -> list[int]:
    """Token counts of whole texts; the calls of the tokenizer get about ``batch_bytes`` each."""
    out = [0] * len(texts)
    waiting: list[str] = []
    owner: list[int] = []
    size = 0
    pieces = model.endswith(".model")

    def flush() -> None:
        if pieces:
            found = _pieces(model).encode(waiting, num_threads=1)
        else:
            found = _words(model).encode_batch_fast(waiting, add_special_tokens=False)
        for k, ids in zip(owner, found, strict=True):
            out[k] += len(ids)
        waiting.clear()
        owner.clear()

    for k, text in enumerate(texts):
        for part in safe_parts(text, split_chars) if pieces else [text]:
            waiting.append(part)
            owner.append(k)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch_bytes:
                flush()
                size = 0
    if waiting:
        flush()
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; no shuffle, one Arrow pass over two columns.

    ``model`` is the path of a public tokenizer (``.model``: sentencepiece, ``.json``: tokenizers) readable on
    every executor.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each; a null
    id stays null; other columns are ignored.  Empty tables give an empty table.  Texts beyond ``SPLIT_CHARS`` are cut
    before single spaces (``.model`` only); one without any, and one of a ``.json`` model, is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in slices(batch, 1, 4 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = encoded_lengths(texts, model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(offs[1:] - offs[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(id_col, text_col).mapInArrow(released(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
