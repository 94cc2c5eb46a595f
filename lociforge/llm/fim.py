"""Fill-in-middle: a text is cut at two unit borders and its parts are put in another order.

The texts of a batch are encoded as runs: maximal stretches of bytes of one
character class.  A run stores where it begins, how many units end in it and
how far apart their ends lie, and the units that end up to its last byte are
counted cumulatively.  A cut after u units is then one binary search for the
run and one multiplication inside it, however long the text is:

    line   newline / other       a newline run of m bytes ends m units, one a byte
    word   blank / other         a blank run ends one unit, its last byte
    char   bytes of a character  a run of m bytes of w-byte characters ends m / w units

The last run of a text ends its last unit whatever its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_slices
from .wordscan import text_bytes

#: Fixed values of the output format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_NEWLINE = np.zeros(256, dtype=np.uint8)
_NEWLINE[10] = 1
_BLANK = np.zeros(256, dtype=np.uint8)
_BLANK[[32, *range(9, 14)]] = 1
#: Bytes of the character that a UTF-8 byte begins; 0 for bytes inside one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.uint8)
UNITS = ("line", "word", "char")


class Runs:
    """The run-length class encoding of a batch of texts (UTF-8 bytes, offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "line"):
        if unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        self.offsets = offsets
        kind = {"line": _NEWLINE, "word": _BLANK, "char": _WIDTH}[unit][data]
        if unit == "char":  # a byte inside a character has its character's class
            first = np.flatnonzero(kind)
            kind = np.repeat(kind[first], np.diff(np.append(first, len(data))))
        begins = np.concatenate([np.flatnonzero(np.diff(kind)) + 1, offsets[:-1][np.diff(offsets) > 0]])
        self.start = np.unique(begins)
        length = np.diff(np.append(self.start, len(data)))
        of = kind[self.start].astype(np.int64)
        if unit == "char":
            self.step, ends = of, length // np.maximum(of, 1)
        elif unit == "line":
            self.step, ends = np.where(of == 1, 1, length), np.where(of == 1, length, 0)
        else:
            self.step, ends = length, of
        last = np.searchsorted(self.start, offsets[1:][np.diff(offsets) > 0]) - 1
        if unit != "char":
            ends[last] = np.maximum(ends[last], 1)
        self.ends = ends
        self.upto = np.cumsum(ends)
        #: Units that end before each text, and the units of each.
        self.before = np.concatenate([[0], self.upto])[np.searchsorted(self.start, offsets)]
        self.n = np.diff(self.before)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte at which each text has had so many of its units (0 to n)."""
        out = self.offsets[:-1].copy()
        some = np.flatnonzero(units > 0)
        wanted = self.before[some] + units[some]
        run = np.searchsorted(self.upto, wanted)
        out[some] = self.start[run] + (wanted - (self.upto[run] - self.ends[run])) * self.step[run]
        return out


def _cut_texts(batches, unit: str):
    for part in text_slices(batches, 1):
        data, offsets = text_bytes(part.column(1))
        runs = Runs(data, offsets, unit)
        of = [np.asarray(part.column(i)).astype(np.int64) % (runs.n + 1) for i in (2, 3)]
        at = [runs.cut(np.minimum(*of)), runs.cut(np.maximum(*of))]
        # The three parts of all texts lie behind one another in the batch's own bytes.
        edges = np.append(np.stack([offsets[:-1], *at], axis=1).ravel(), offsets[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(3 * len(part), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
        parts = [pieces.take(pa.array(np.arange(i, 3 * len(part), 3))) for i in range(3)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs.n), *parts], names=["id", "n", "prefix", "middle", "suffix"])
        del data, runs, pieces, parts
        give_back()


def _draw(key: Column, seed: int, i: int) -> Column:
    """The i-th group of eight hexadecimal digits (from 0) of SHA-256 of 'seed:key', as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, suffix_first: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), a row for each row of docs.

    n: units of the text; rate: per cent of the texts that are transformed;
    suffix_first: per cent of those that take the form spm, not psm.  A text
    that is empty, or holds one of the three marks, stays as it is: form plain,
    and the two counts (code points) are null.  A null text is empty, a null id
    counts as an empty one in the draws; equal ids are cut alike and repeated
    rows stay; texts of any length are cut whole; an empty table gives no rows;
    other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    drawn = rows.select("id", "text", _draw(F.col("id"), seed, 0).alias("h1"), _draw(F.col("id"), seed, 1).alias("h2"))
    cut = drawn.mapInArrow(lambda batches: _cut_texts(batches, unit), f"id {kind}, n long, prefix string, middle string, suffix string")
    held = F.concat("prefix", "middle", "suffix")
    marks = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marks = marks | F.contains(held, F.lit(mark))
    plain = (held == "") | marks | (_draw(F.col("id"), seed, 2) % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(_draw(F.col("id"), seed, 3) % 100 < suffix_first, F.lit("spm")).otherwise(F.lit("psm"))
    out = cut.withColumn("form", form)
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    chars = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return out.select(
        "id",
        "n",
        "form",
        chars("prefix").alias("prefix_chars"),
        chars("middle").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(held).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of; null for another form or an output without its marks."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm = F.concat(part(1), part(3), part(2))
    spm = F.concat(part(2), part(3), part(1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
