"""Token counts of whole documents without token ids.

No piece of the vocabulary holds a word mark (U+2581, a space) after another character, so no merge crosses the border
before a run of marks: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies
and summed.

Pre-tokens that hold more than a fixed share of a slice of the corpus are the frequent ones. Each slice names at most
1/share of them, and those whose slices together hold half that share of the corpus number at most 2/share, whatever the
corpus size; their counts are broadcast. The other pre-tokens meet in one shuffle by pre-token, where none is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import id_and_text, shuffle_width, small_batches

MARK = "▁"
NAMES = ["row_id", "doc_id", "n_bytes", "word", "n"]
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_MARK_RUN = re.compile(f"{MARK}{MARK}|{MARK}$")


@cache
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    loaded = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (loaded.id_to_piece(i) for i in range(loaded.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("this vocabulary has pieces across words; its texts can't be counted by pre-token")
    return loaded


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of ``text``, each without its leading mark, which the library's dummy prefix puts back."""
    if not text:
        return []
    text = text.replace(" ", MARK)
    if _MARK_RUN.search(text) or text[0] == MARK:
        return [part[1:] for part in _CUT.split(MARK + text)]
    return text.split(MARK)


def count_pieces(path: str, words: list[str]) -> list[int]:
    """Pieces of each pre-token. One of marks alone keeps them: the library would take an empty text for no text."""
    counts = [len(ids) for ids in model(path).encode(words, num_threads=1)]
    return [n if word else 1 for n, word in zip(counts, words)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, share: float = 1 / 800_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each input row, also where ids repeat or are null.

    Null text counts as empty: no bytes, no tokens. Texts of any length are counted whole. ``share`` bounds the broadcast
    (2/share pre-tokens of at most 64 characters); it changes the traffic, never the counts. No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    frequent = _frequent(rows.select("text"), share)
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent, count_pieces(model_path, frequent))))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (word, frequency) for each rarer pre-token of a document; one without word for all the others."""
        counts = known.value
        for batch in small_batches(batches):
            at, words, freq, sizes, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                total = 0
                for word, n in Counter(pre_tokens(text)).items():
                    if (pieces := counts.get(word)) is not None:
                        total += pieces * n
                    else:
                        at.append(i)
                        words.append(word)
                        freq.append(n)
                totals.append(total)
                sizes.append(len(text.encode()))
            n, keys = batch.num_rows, batch.column(2)
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(0), pa.array(sizes, pa.int64()), pa.nulls(n, pa.string()), pa.array(totals, pa.int64())], names=NAMES)
            if at:
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(keys, pa.array(at)), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.int64()),
                     pa.array(words, pa.string()), pa.array(freq, pa.int64())], names=NAMES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word, so each distinct one is counted once, or carried over from the batch before."""
        last: dict[str, int] = {}
        for batch in batches:
            words = batch.column(3).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            fresh = [word for word in distinct if word not in last]
            table = last | dict(zip(fresh, count_pieces(model_path, fresh)))
            last = {word: table[word] for word in distinct[-1:]}
            each = pc.take(pa.array([table[word] for word in distinct], pa.int64()), words.indices)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pc.multiply(batch.column(4), pc.fill_null(each, 1))], names=["row_id", "doc_id", "n_bytes", "n"])

    found = rows.mapInArrow(frequencies, f"row_id long, doc_id {id_type}, n_bytes long, word string, n long")
    key = F.when(F.col("word").isNull(), F.xxhash64("row_id")).otherwise(F.xxhash64("word"))
    met = found.repartition(shuffle_width(docs), key).sortWithinPartitions("word")
    counted = met.mapInArrow(pieces, f"row_id long, doc_id {id_type}, n_bytes long, n long")
    return (counted.groupBy("row_id")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def _frequent(texts: DataFrame, share: float) -> list[str]:
    """At most 2/share pre-tokens, with every one that holds 1.5 times ``share`` of the corpus among them."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0

        def told() -> pa.RecordBatch:
            heavy = [(word, n) for word, n in seen.items() if n > max(1, share * total) and len(word) <= 64]
            return pa.RecordBatch.from_arrays(
                [pa.array([None, *(word for word, _ in heavy)], pa.string()), pa.array([total, *(n for _, n in heavy)], pa.int64())],
                names=["word", "n"])

        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                words = pre_tokens(text)
                seen.update(words)
                total += len(words)
            if len(seen) > 500_000:
                yield told()
                seen.clear()
                total = 0
        yield told()

    sums = cut_lineage(texts.mapInArrow(local, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = sums.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    return [row.word for row in sums.where(F.col("word").isNotNull() & (F.col("n") > share / 2 * total)).collect()]
