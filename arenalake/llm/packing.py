"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import materialise

#: Permitted sequence lengths in words, ascending.
LENGTHS = (512, 1024, 2048, 4096)
#: Pieces of a shard, about; a shard is packed in one task.
SHARD_PIECES = 10_000
#: Copies of one row that are numbered at once.
COPIES = 1000


def sequence_cost(length: int) -> float:
    """Relative cost of training on one sequence: a fixed part, a linear part, attention's quadratic part."""
    return 64 + length + length * length / 32_768


def word_count(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), ""))


class OpenBins:
    """Open bins by room left. A bitmap of the rooms in use finds the least sufficient one."""

    def __init__(self) -> None:
        self.used, self.bins = 0, {}

    def put(self, room: int, bin_no: int) -> None:
        if room:
            self.bins.setdefault(room, []).append(bin_no)
            self.used |= 1 << room

    def best_fit(self, size: int) -> tuple[int, int] | None:
        """(bin, room) with the least room of at least `size`; the newest bin of that room."""
        fits = self.used >> size
        if not fits:
            return None
        room = size + ((fits & -fits).bit_length() - 1)
        bins = self.bins[room]
        bin_no = bins.pop()
        if not bins:
            del self.bins[room]
            self.used ^= 1 << room
        return bin_no, room


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over sizes (descending, at most lengths[-1]): bin, offset, and length per bin.

    Where no open bin has room, all permitted lengths that hold the piece compete: the one with
    the least cost per word it can come to hold, given the words still to be placed in pieces
    that fit beside this one. At the end each bin shrinks to the shortest length for its contents.
    """
    costs = [(c, sequence_cost(c)) for c in lengths]
    open_bins, room_of, length_of = OpenBins(), [], []
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left = np.concatenate((np.cumsum(sizes[::-1])[::-1], [0]))
    smaller = {c: np.searchsorted(-sizes, -np.arange(c + 1), side="left") for c, _ in costs}
    for i, size in enumerate(sizes.tolist()):
        found = open_bins.best_fit(size)
        if found is None:
            def per_word(option: tuple[int, float]) -> tuple[float, int]:
                c, cost = option
                spare = c - size
                fill = min(spare, int(left[max(i + 1, int(smaller[c][spare]))]))
                return cost / (size + fill), c

            length = min((o for o in costs if o[0] >= size), key=per_word)[0]
            found = (len(room_of), length)
            room_of.append(length)
            length_of.append(length)
        bin_no, room = found
        bin_of[i], offset[i] = bin_no, length_of[bin_no] - room
        room_of[bin_no] = room - size
        open_bins.put(room - size, bin_no)
    used = np.array(length_of, np.int64) - np.array(room_of, np.int64)
    ladder = np.array(lengths, np.int64)
    return bin_of, offset, ladder[np.searchsorted(ladder, used)] if len(used) else used


def pieces_of(docs: DataFrame, longest: int = LENGTHS[-1]) -> DataFrame:
    """doc_id, text_hash, copy, piece, first_word, n_words: whole texts, cut where they outgrow the longest sequence.

    copy numbers the rows of one doc_id and text: they are counted first, so a row that repeats
    very often is never gathered, and its copies are numbered COPIES at a time.
    """
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("total"))
    grouped = counted.where("total > 0").groupBy("doc_id", "text_hash", "total").agg(F.count("*").alias("n"))
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    dealt = grouped.select("*", portion.alias("portion"))
    most = F.least(F.col("n"), (F.col("portion") + 1) * COPIES) - 1
    each = dealt.select("doc_id", "text_hash", "total", F.explode(F.sequence(F.col("portion") * COPIES, most)).alias("copy"))
    last = F.floor((F.col("total") - 1) / longest).cast("int")
    cut = each.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * longest
    return cut.select("doc_id", "text_hash", "copy", "piece", first.alias("first_word"), F.least(F.col("total") - first, F.lit(longest)).cast("int").alias("n_words"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece: sequence_id, length, used, doc_id, piece, first_word, n_words, offset.

    A document longer than the longest permitted sequence is cut into pieces; every word of every
    text lands in exactly one sequence. Texts that are null or have no words take no room and give
    no row; repeated rows are packed as often as they occur. Pieces are dealt to shards by a hash of
    row, copy and piece, and each shard is packed by itself, larger pieces first and ties by doc_id
    and text hash. The number of shards follows the number of pieces alone, so the result depends
    neither on how the input was partitioned nor on the session. Null doc_ids are packed like
    others. Extra columns are ignored; an empty table gives no row.
    """
    pieces = materialise(pieces_of(docs, lengths[-1]), "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "text_hash", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        sizes = pdf["n_words"].to_numpy(np.int64)
        bin_of, offset, length = pack(sizes, lengths)
        used = np.bincount(bin_of, weights=sizes, minlength=len(length)).astype(np.int64)
        head = f"{int(pdf['shard'].iloc[0])}-"
        return pd.DataFrame({
            "sequence_id": [head + str(b) for b in bin_of], "length": length[bin_of], "used": used[bin_of], "doc_id": pdf["doc_id"],
            "piece": pdf["piece"], "first_word": pdf["first_word"], "n_words": pdf["n_words"], "offset": offset,
        })

    schema = "sequence_id string, length int, used int, doc_id bigint, piece int, first_word bigint, n_words int, offset int"
    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(place, schema)
