"""Best-two-fit packing of token pieces into sequences of a fixed length.

Every document is encoded, gets an end id and, only where it is longer than a sequence, is cut into pieces of full
length of which the first may be shorter. Pieces are dealt by hash to groups of a bounded number of pieces, and each group
is packed on its own: a sequence is filled greedily (the longest unpacked piece that fits, again and again), then its
smallest piece is taken out wherever two unpacked pieces fill the widened gap more tightly, before the next one begins. With ``GROUP_PIECES`` pieces in a
group, dealing costs at most one partly filled sequence in thousands.

Cases: null and empty texts are the end id alone; a null id is packed like any other; repeated rows are packed as often
as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import Recent, batch, map_batches, staged, table, tokenizer_file

SEQUENCE, END_ID = 2048, 0
#: Aim for the pieces packed together in one task.
GROUP_PIECES = 20_000
#: Entries of each generation of the memo of words.
WORDS = 300_000
SPECIAL = {"<|endoftext|>": 50256}
#: Where a text holds a run of white space, cutting it at single spaces isn't exact and it is encoded whole.
_SPECIAL_MARK = "<|endoftext|>"
#: White space from this length on is cut out before the pattern sees it, whose backtracking would overflow the stack.
#: The white space of the tokenizer's pattern.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")


class ByteEncoder:
    """Ids of a text as little-endian 32-bit integers.

    No token crosses a single space that stands between two other characters: the space begins the next token. So a
    text without double spaces is cut there, and what repeats is looked up.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
        self.memo = Recent(self.direct, WORDS)

    def direct(self, text: str) -> bytes:
        if _SPECIAL_MARK in text:
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def parted(self, text: str) -> bytes:
        """``direct`` with long white space cut out: before another character its last sign goes with what follows,
        and the rest is one piece; at the end the whole of it is."""
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out.append(self.direct(text[at : run.start()]))
            out.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4").tobytes())
            at = end
        return b"".join([*out, self.direct(text[at:])])

    def __call__(self, text: str) -> bytes:
        if "  " in text or _SPECIAL_MARK in text or text[-1:].isspace() or text[:1].isspace():
            return self.parted(text)
        first, *rest = text.split(" ")
        memo = self.memo
        return memo[first] + b"".join([memo[" " + x] for x in rest])


def piece_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole up to ``most``, else full pieces after a first of what is left over."""
    if n <= most:
        return [n]
    head = n % most
    return [head] * bool(head) + [most] * (n // most)


def pieces(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteEncoder(ranks_path)
        end = np.array([END_ID], "<u4").tobytes()
        for rows in batches:
            out: list[tuple] = []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                start = 0
                for k, length in enumerate(piece_lengths(len(ids) // 4)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc_id, k, start, length, crc))
                    start += length
            columns = list(zip(*out)) or [[]] * 5
            yield batch(
                doc_id=(columns[0], pa.int64()),
                piece=(columns[1], pa.int32()),
                start=(columns[2], pa.int64()),
                length=(columns[3], pa.int64()),
                ids_crc32=(columns[4], pa.int64()),
            )

    return map_batches(
        docs.select("doc_id", "text"), task, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class _Unpacked:
    """The lengths that are still unpacked, as a set of bits each way, and the pieces of each length."""

    def __init__(self, lengths: list[int], most: int):
        self.most = most
        self.pieces: list[list[int]] = [[] for _ in range(most + 1)]
        for i in sorted(range(len(lengths)), reverse=True):
            self.pieces[lengths[i]].append(i)
        self.bits = sum(1 << n for n in range(1, most + 1) if self.pieces[n])
        #: The same from the other end, so that one shift lines up lengths of equal sum.
        self.mirror = sum(1 << (most - n) for n in range(1, most + 1) if self.pieces[n])

    def largest(self, room: int) -> int:
        """The largest length of at most ``room``; 0 if there is none."""
        return max(0, (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two lengths of the largest sum up to ``room`` that exceeds ``above``."""
        for total in range(room, max(above, 1), -1):
            # a bit y is set in the shifted mirror where total - y is unpacked
            shift = self.most - total
            other = self.mirror >> shift if shift >= 0 else self.mirror << -shift
            found = self.bits & other & ((1 << total) - 2)
            if total % 2 == 0 and len(self.pieces[total // 2]) == 1:
                found &= ~(1 << (total // 2))
            if found:
                one = found.bit_length() - 1
                return one, total - one
        return None

    def take(self, n: int) -> int:
        i = self.pieces[n].pop()
        if not self.pieces[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.most - n)
        return i

    def give_back(self, n: int, i: int) -> None:
        if not self.pieces[n]:
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.most - n)
        self.pieces[n].append(i)


def best_two_fit(lengths: list[int], most: int = SEQUENCE, replace: bool = True) -> list[list[int]]:
    """Bins of indices. A bin takes the largest unpacked piece that fits while there is one. Then its smallest piece goes
    back wherever two unpacked pieces fill the widened gap more tightly, until none do; only then the next bin begins.
    ``replace``: without it the greedy filling alone."""
    unpacked = _Unpacked(lengths, most)
    bins = []
    while unpacked.bits:
        items: list[int] = []
        gap = most
        while n := unpacked.largest(gap):
            items.append(unpacked.take(n))
            gap -= n
        while replace and gap and len(items) > 1:
            # largest first, so the smallest is the last
            small = items[-1]
            pair = unpacked.two(gap + lengths[small], lengths[small])
            if pair is None:
                break
            items.pop()
            gap += lengths[small] - sum(pair)
            new = [unpacked.take(n) for n in pair]
            unpacked.give_back(lengths[small], small)
            items = sorted(items + new, key=lambda i: -lengths[i])
        bins.append(items)
    return bins


def pack(parts: DataFrame, count: int) -> DataFrame:
    """``parts`` with sequence_id and offset; ``count``: its rows, which gives the number of groups."""
    groups = max(1, -(-count // GROUP_PIECES))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        base = int(rows["group__"].iloc[0])
        for k, items in enumerate(best_two_fit(lengths)):
            at = 0
            for i in items:
                sequence[i], offset[i] = base + k * groups, at
                at += lengths[i]
        return rows.drop(columns="group__").assign(sequence_id=sequence, offset=offset)

    dealt = parts.withColumn(
        "group__", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    )
    return dealt.groupBy("group__").applyInPandas(
        group,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Encode, cut and pack rows (doc_id, text). The pieces (numbers only) are written once between the two."""
    parts = staged(pieces(docs, tokenizer_file("byte_bpe_50k.tiktoken")), "pieces")
    return pack(parts, parts.count())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
