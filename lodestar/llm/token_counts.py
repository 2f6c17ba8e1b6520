"""Token counts by overlap resynchronisation.

A text longer than a chunk is encoded in chunks that overlap. In each overlap the end of one chunk's encoding and the
beginning of the next one's are held against each other by their offsets: they are spliced at the first position that
is a token boundary in both and stands after plain white space. For a tokenizer that drops white space before it splits
words (others are refused), no token, special token, normalisation or merge can reach over such a position, so the spliced
count is the count of the whole text. Where an overlap has no such position it is widened, to the end of the text if
need be.

For the same reason what stands between two stable positions has the same tokens wherever it stands: a worker remembers
the counts of such pieces (a bounded memo), and a chunk's count is the sum of its pieces'.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids give a row each; a null id
stays null; an empty table gives an empty result; texts may be of any length (memory grows with the longest text and the
longest run without white space); other columns are neither read nor returned.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import hold, map_arrow, sub_batches, table

STABLE = " \t\n\r"
MEMO = 500_000  # pieces whose counts a worker keeps; the memo starts anew beyond that
_memos: dict[str, dict[str, int]] = {}
_SPLIT = re.compile(r"[^ \t\n\r]+").findall


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if not drops_space(tok):
        raise ValueError("this tokenizer keeps white space: it has no stable boundary there")
    return tok


def _memo(path: str) -> dict[str, int]:
    """This worker's counts, kept from task to task."""
    return _memos.setdefault(path, {})


def _forget() -> None:
    _memos.clear()


def drops_space(tok) -> bool:
    """Whether white space is in no token, so that positions after it are stable."""
    return tok.encode("a b", add_special_tokens=False).offsets == [(0, 1), (2, 3)] and all(a != b and not x[a:b].isspace() for x in (" a\t\tb\n", "a \r b") for a, b in tok.encode(x, add_special_tokens=False).offsets)


def spliced(tok, text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of text that are counted from one chunk each, in turn: they join at the splices."""
    if not 0 < overlap < chunk:
        raise ValueError("a chunk has to be longer than the overlap")
    out, floor, end, size = [], 0, chunk, len(text)
    while end < size:
        wide, at = overlap, 0
        while not at:
            stop = min(size, end + wide)
            at = _common_boundary(tok, text, floor, end, stop)
            if stop == size:
                break
            wide *= 2
        if not at:
            break  # no two encodings agree up to the end: the rest is one part
        out.append((floor, at))
        floor, end = at, max(end, at) + chunk - overlap
    return [*out, (floor, size)]


def _common_boundary(tok, text: str, floor: int, end: int, stop: int) -> int:
    """The first position of the overlap from end to stop that is stable and a boundary of both encodings, or 0. The
    chunk before is encoded from its last stable position before the overlap on, the next one from the overlap on."""
    start = max((text.rfind(c, floor, end) for c in STABLE), default=-1) + 1 or floor
    left = _ends(tok, text, start, stop)
    right = _ends(tok, text, end, stop)
    for at in sorted(left[0] & right[0]):
        if at > end and text[at - 1] in STABLE and not any(a < at < b for a, b in left[1] | right[1]):
            return at
    return 0


def _ends(tok, text: str, start: int, stop: int) -> tuple[set[int], set[tuple[int, int]]]:
    """Where tokens begin, and the tokens that have more than one character."""
    spans = [(a + start, b + start) for a, b in tok.encode(text[start:stop], add_special_tokens=False).offsets]
    return {a for a, _ in spans}, {x for x in spans if x[1] - x[0] > 1}


def _counts(tok, texts: list[str], memo: dict[str, int]) -> list[int]:
    """Tokens of each text, from the counts of what stands between its stable positions. memo: counts so far."""
    if len(memo) > MEMO:
        memo.clear()
    pieces = [_SPLIT(x) for x in texts]
    new = list({p for ps in pieces for p in ps if p not in memo})
    memo.update(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    return [sum(map(memo.__getitem__, ps)) for ps in pieces]


def count_tokens(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 2048, overlap: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. tokenizer: path of a tokenizer file, readable on executors;
    chunk, overlap: in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", _forget)
        tok, memo = _tokenizer(tokenizer), _memo(tokenizer)
        for batch in sub_batches(batches, "text", 1 << 19):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            parts = [spliced(tok, x, chunk, overlap) for x in texts]
            counts = iter(_counts(tok, [x[a:b] for x, ps in zip(texts, parts, strict=True) for a, b in ps], memo))
            n = [sum(next(counts) for _ in ps) for ps in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
