"""Token counts with a public tokenizer, by Arrow batches that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices

#: Bytes that one call of the tokenizer gets, and segments whose counts a worker remembers.
CALL_BYTES, REMEMBERED = 1 << 20, 1 << 18
#: A single space between characters that are neither a space nor the mark that stands for one.
_BREAK = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _segments(text: str) -> list[str]:
    """Pieces whose token counts add up to the text's.

    SentencePiece puts a mark before a text and in place of each space; no piece of such a
    vocabulary has the mark after another character, so no merge crosses a single space, and a
    segment's own leading mark stands for the space that was cut out.
    """
    if "  " not in text and "▁" not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return _BREAK.split(text)


def _sentencepiece(path: str) -> tuple[Callable[[str], list[str]], Callable[[list[str]], list[int]]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    splits = all(not model.id_to_piece(i).strip(mark) or mark not in model.id_to_piece(i)[1:] for i in range(model.vocab_size()))
    return _segments if splits else lambda text: [text], lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _tokenizers(path: str) -> tuple[Callable[[str], list[str]], Callable[[list[str]], list[int]]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda text: [text], lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _lengths(texts: list[str], cut: Callable, encode: Callable, known: dict[str, int]) -> list[int]:
    parts = [cut(x) for x in texts]
    fresh = list({s for p in parts for s in p if s not in known})
    found, i = {}, 0
    while i < len(fresh):
        j, size = i, 0
        while j < len(fresh) and (j == i or size + _bytes(fresh[j]) <= CALL_BYTES):
            size += _bytes(fresh[j])
            j += 1
        found.update(zip(fresh[i:j], encode(fresh[i:j]), strict=True))
        i = j
    if len(known) + len(found) > REMEMBERED:
        known.clear()
        out = [sum(found[s] if s in found else encode([s])[0] for s in p) for p in parts] if len(found) > REMEMBERED else None
        if out is not None:
            return out
        missing = list({s for p in parts for s in p if s not in found})
        found.update(zip(missing, encode(missing) if missing else [], strict=True))
    known.update(found)
    return [sum(map(known.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one pass without a shuffle.

    ``model`` is the path of a .model (sentencepiece) or .json (tokenizers) file that the executors
    can read. No begin, end or added special tokens; strings of special tokens inside a text as
    the library takes them by default. Whole texts: long ones are cut only where the counts add
    up. Null and empty texts have 0 bytes and 0 tokens; repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """
    load = _sentencepiece if model.endswith(".model") else _tokenizers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, encode = load(model)
        known: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column(1), "")
                tokens = pa.array(_lengths(texts.to_pylist(), cut, encode, known), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), tokens], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
