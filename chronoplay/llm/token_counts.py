"""Token counts of a byte-level BPE, with overlap resynchronisation for huge texts.

Ordinary texts: white space after another character always starts a new
pre-token of this tokenizer, so a text falls into independent spans there. The
distinct spans of a slice of texts are encoded by the library once, and a text's
count is the sum over its spans.

Huge texts (over ``huge`` characters) are encoded in overlapping chunks with
offsets. The pre-tokenizer is a scanner without memory: if two encodings both
start a pre-token at a place, they agree from there on. Such a common boundary
is stable unless it lies in the last two pre-tokens of the first chunk, which
its end may have cut. The chunks are spliced at the first stable common
boundary; if the overlap has none, it is doubled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_slices, spans_array, sums_by_row, tidy

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
#: Spans whose counts a worker remembers between slices, of at most so many bytes.
REMEMBER, LONG_SPAN = 400_000, 64
#: Bytes of texts that are counted at a time, or one longer text.
SLICE = 2 << 20


@lru_cache(maxsize=2)
def load(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    return Tokenizer.from_file(path)


def _boundaries(encoding) -> np.ndarray:
    """Where pre-tokens start, in characters."""
    words = encoding.word_ids
    return np.array([s for i, (s, _) in enumerate(encoding.offsets) if not i or words[i] is None or words[i] != words[i - 1]], dtype=np.int64)


def count_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, encoded chunk by chunk; equal to encoding it whole."""
    total = start = 0
    while True:
        end, wide = start + chunk, overlap
        while end + wide < len(text):
            left = tokenizer.encode(text[start : end + wide], add_special_tokens=False)
            right = tokenizer.encode(text[end : end + wide], add_special_tokens=False)
            stable, other = _boundaries(left)[:-2] + start, _boundaries(right)[1:-2] + end
            common = np.intersect1d(stable, other)
            if len(common):
                cut = int(common[0])
                total += sum(s + start < cut for s, _ in left.offsets)
                start = cut
                break
            wide *= 2  # no common boundary: widen
        else:
            return total + len(tokenizer.encode(text[start:], add_special_tokens=False).ids)


def _span_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of independent spans: the rows' starts, and ASCII white space after what isn't white space."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    cut = white[1:] & ~white[:-1]
    # not after any of Unicode's other white space, nor after a control character that counts as such
    b1, b2, b3 = data[:-1], np.concatenate(([0], data[:-2])), np.concatenate(([0, 0], data[:-3]))
    cut &= ~((b1 >= 28) & (b1 <= 31))
    cut &= ~((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)))
    cut &= ~((b3 == 0xE1) & (b2 == 0x9A)) & ~((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) & ~((b3 == 0xE3) & (b2 == 0x80))
    flags = np.zeros(len(data) + 1, bool)
    flags[1 : len(data)] = cut
    flags[rows[:-1]] = True
    return np.flatnonzero(flags[:-1])


def token_counter(path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
    """A function from an array of texts to their token counts."""
    known: dict[bytes, int] = {}

    def counts(texts: pa.Array) -> np.ndarray:
        tokenizer, out = load(path), []
        for _, _, data, rows in byte_slices(texts, SLICE):
            big = np.flatnonzero(np.diff(rows) > huge)
            sums = np.zeros(len(rows) - 1, np.int64)
            if len(data):
                starts = _span_starts(data, rows)
                inside = np.searchsorted(starts, rows)
                use = np.ones(len(starts), bool)
                for i in big:
                    use[inside[i] : inside[i + 1]] = False
                coded = spans_array(data, starts).filter(pa.array(use)).dictionary_encode()
                spans = coded.dictionary.to_pylist()
                new = [s for s in spans if s not in known]
                fresh = dict(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)), strict=True))
                each = np.fromiter((known[s] if s in known else fresh[s] for s in spans), np.int64, len(spans))
                if len(known) < REMEMBER:
                    known.update((s, n) for s, n in fresh.items() if len(s) <= LONG_SPAN)
                values = np.zeros(len(starts), np.int64)
                values[use] = each[coded.indices.to_numpy(zero_copy_only=False)] if len(spans) else 0
                sums = sums_by_row(values, inside)
                for i in big:
                    text = data[rows[i] : rows[i + 1]].tobytes().decode()
                    sums[i] = count_huge(tokenizer, text, chunk, overlap) if len(text) > huge else len(tokenizer.encode(text, add_special_tokens=False).ids)
            out.append(sums)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_tokens, over_limit.

    ``n_tokens`` is what the library gives for the whole text, without added
    special tokens; special strings inside a text are handled as its default.
    Null counts as empty (0 bytes, 0 tokens). Ids are passed on as they are,
    nulls and repeats too; an empty table gives an empty result. Only the two
    named columns are read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = token_counter(tokenizer_path, huge, chunk, overlap)
        for b in batches:
            sizes = [int(n) for _, _, _, rows in byte_slices(b.column(1)) for n in np.diff(rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts(b.column(1)), pa.int64())], ["_id", "n_bytes", "n_tokens"])

    out = base.mapInArrow(tidy(run), f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
