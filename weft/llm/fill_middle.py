"""Fill-in-the-middle: a text is cut at two of its lines, and its middle moves to the end.

A text's lines are counted block by block over its UTF-8 bytes. On the way,
every STRIDE lines, a checkpoint keeps the byte and the code point where the
next line begins. A cut behind line u is found by binary search of the
checkpoints and a scan of at most STRIDE lines from there, so that a text of
any length is walked once and its lines are never held.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import append_columns

#: Lines between two checkpoints, and bytes that are counted together.
STRIDE, BLOCK_BYTES = 64, 1 << 20
#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _points(data: np.ndarray) -> int:
    """Code points that begin in UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class LineIndex:
    """Sparse checkpoints of a text's lines: lines[k] lines end before byte byte[k], which is code point point[k]."""

    def __init__(self, data: bytes, stride: int = STRIDE, block_bytes: int = BLOCK_BYTES):
        self.data = data
        self.lines, self.bytes, self.points = [0], [0], [0]
        found = point = 0
        whole = np.frombuffer(data, np.uint8)
        for start in range(0, len(data), block_bytes):
            block = whole[start : start + block_bytes]
            ends = np.flatnonzero(block == 10)
            at = 0
            for k in range(-found % stride or stride, len(ends) + 1, stride):
                stop = int(ends[k - 1]) + 1
                point += _points(block[at:stop])
                at = stop
                self.lines.append(found + k)
                self.bytes.append(start + stop)
                self.points.append(point)
            point += _points(block[at:])
            found += len(ends)
        #: Lines of the text, the last one with or without an end; code points of the text.
        self.count = found + (0 if not data or data.endswith(b"\n") else 1)
        self.size = point

    def cut(self, lines: int) -> tuple[int, int]:
        """The byte and the code point behind so many lines."""
        if lines >= self.count:
            return len(self.data), self.size
        k = bisect_right(self.lines, lines) - 1
        at = start = self.bytes[k]
        for _ in range(lines - self.lines[k]):
            at = self.data.index(b"\n", at) + 1
        return at, self.points[k] + _points(np.frombuffer(self.data, np.uint8, at - start, start))


def fill_in_middle(
    docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output: the text with its middle behind its prefix and suffix.

    A text is cut into its n lines, each with its end. Four numbers, of the
    SHA-256 of seed, a colon and the decimal doc_id (nothing if it is null),
    choose: the first two modulo n + 1 the lines before the middle and before
    the suffix, the third, below rate of 100, whether the text is cut, the
    fourth, below spm of 100, the form. Form psm is prefix, suffix, middle
    behind their marks, spm is suffix, prefix, middle; plain is the text as it
    is: an empty or null one (an empty output), one that holds a mark, or one
    that is not chosen. prefix_chars and middle_chars count code points, null
    if plain. Rows that repeat an id and a text get the same output. Columns
    that clash with new ones are replaced; an empty table gives an empty
    result. A task holds one batch of texts, or one text that is longer.
    """
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    p_mark, s_mark, m_mark = marks

    def make():
        def convert(ids, texts):
            rows = [_convert(i, t.as_buffer()) for i, t in zip(ids.to_pylist(), texts.cast(pa.large_binary()), strict=True)]
            n, form, before, inside, output = zip(*rows, strict=True) if rows else ((),) * 5
            return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.string())]

        def _convert(number, buffer):
            data = b"" if buffer is None else buffer.to_pybytes()
            index = LineIndex(data)
            digest = hashlib.sha256(f"{seed}:{'' if number is None else number}".encode()).hexdigest()
            one, two, chosen, kind = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
            if not data or chosen % 100 >= rate or any(m in data for m in marks):
                return index.count, "plain", None, None, data
            cuts = sorted((one % (index.count + 1), two % (index.count + 1)))
            (a, a_point), (b, b_point) = index.cut(cuts[0]), index.cut(cuts[1])
            prefix, middle, suffix = data[:a], data[a:b], data[b:]
            if kind % 100 < spm:
                return index.count, "spm", a_point, b_point - a_point, b"".join((s_mark, suffix, p_mark, prefix, m_mark, middle))
            return index.count, "psm", a_point, b_point - a_point, b"".join((p_mark, prefix, s_mark, suffix, m_mark, middle))

        return convert

    return append_columns(docs, [doc_id, text], make, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.

    The parts hold no mark, and no mark begins inside another, so each mark is
    found at its first place.
    """
    mark = len(PREFIX)

    def join(first: str) -> Column:
        behind = F.substr(output, F.lit(mark + 1))
        one = F.substring_index(behind, first, 1)
        rest = F.substr(behind, F.length(one) + (mark + 1))
        two = F.substring_index(rest, MIDDLE, 1)
        middle = F.substr(rest, F.length(two) + (mark + 1))
        return F.concat(one, middle, two) if first == SUFFIX else F.concat(two, middle, one)

    return F.when(form == "psm", join(SUFFIX)).when(form == "spm", join(PREFIX)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of docs(doc_id, text) in fill_in_middle()."""
    moved = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    back = restored(F.col("output"), F.col("form"))
    return moved.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
