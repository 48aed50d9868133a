"""Fill-in-middle transformation through a learned rank index.

The units of a text are its lines (``[^\\n]*\\n|[^\\n]+``). A rank index holds the offset of every unit boundary as a
piecewise-linear model: error-bounded segments predict the offset of a rank, and the stored residual of that rank makes
it exact. Two hashed ranks choose where prefix, middle and suffix part; the index says at which code points.

Every row is transformed by itself: no shuffle, and memory follows the longest text of a batch.

Cases: null and empty text, and a text that holds a sentinel, keep their text as form ``plain`` (null counts as empty); a
text without a line feed is one unit, so one of the three parts holds it whole; a null id hashes as the empty text; repeated rows
give repeated results; an empty table gives no rows; of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, map_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest distance of a prediction from the offset it stands for; residuals fit one byte.
ERROR = 100
#: Of 100 texts: transformed at all, and of these with the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7


@dataclass(frozen=True)
class RankIndex:
    """Offset of each rank: ``base + slope * (rank - first)`` of its segment, rounded, plus the residual of the rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> "RankIndex":
        """Segments by a shrinking cone: a segment goes on while one slope from its first offset passes every later
        one within ``error``."""
        if not 1 <= error <= 127:
            raise ValueError("error must be 1 to 127, so that residuals fit one byte")
        # half of a unit is left to rounding
        room = error - 0.5
        first, slope, low, high, start = [], [], -np.inf, np.inf, 0
        values = offsets.tolist()
        for i, value in enumerate(values):
            if i == start:
                continue
            run, rise = i - start, value - values[start]
            lo, hi = max(low, (rise - room) / run), min(high, (rise + room) / run)
            if lo > hi:
                first.append(start)
                slope.append((low + high) / 2 if i - start > 1 else 0.0)
                start, low, high = i, -np.inf, np.inf
            else:
                low, high = lo, hi
        first.append(start)
        slope.append((low + high) / 2 if len(values) - start > 1 else 0.0)
        at = np.array(first, np.int64)
        model = cls(at, offsets[at], np.array(slope), np.zeros(0, np.int8))
        residual = offsets - model.predict(np.arange(len(offsets)))
        return cls(model.first, model.base, model.slope, residual.astype(np.int8))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        guess = self.base[segment] + self.slope[segment] * (ranks - self.first[segment])
        return np.rint(guess).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets: predictions corrected by their residuals."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(text: str) -> np.ndarray:
    """Code-point offsets of the unit boundaries, 0 first and the text's length last."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    inner = ends if len(ends) and ends[-1] == len(points) else np.append(ends, len(points)) if len(points) else ends
    return np.concatenate([[0], inner]).astype(np.int64)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, error: int = ERROR
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row (doc_id, text).

    ``n`` is the number of units, ``form`` plain, psm (prefix, suffix, middle) or spm (suffix first); the lengths are
    code points, null where plain.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            texts, *hashes = (rows.column(k).to_pylist() for k in range(1, 6))
            for text, h1, h2, h3, h4 in zip(texts, *hashes):
                text = text or ""
                bounds = boundaries(text)
                n = len(bounds) - 1
                if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    made = (n, "plain", None, None, text)
                else:
                    ranks = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
                    a, b = RankIndex.fit(bounds, error).offsets(ranks).tolist()
                    if h4 % 100 < suffix_first:
                        form, output = "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
                    else:
                        form, output = "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                    made = (n, form, a, b - a, output)
                for name, value in zip(out, made):
                    out[name].append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield batch(doc_id=rows.column(0), **{k: (v, t) for (k, v), t in zip(out.items(), kinds)})

    drawn = docs.select("doc_id", "text", *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    return map_batches(
        drawn, task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: Column, output: Column) -> Column:
    """The text behind an output. No sentinel can arise where a part meets a sentinel, so the first one found is it."""
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    start = F.lit(len(PREFIX) + 1)
    cut = F.instr(output, first)
    # the second sentinel comes after the first
    end = F.locate(MIDDLE, output)
    one = F.substring(output, start, cut - start)
    two = F.substring(output, cut + F.lit(len(SUFFIX)), end - cut - F.lit(len(SUFFIX)))
    three = F.substring(output, end + F.length(second), F.length(output))
    moved = F.when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
    return F.when(form == "plain", output).otherwise(moved)


def op11_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


#: The same in SQL, over ids that are not null.
OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS parts,
    sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST(len(parts) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), split AS (
  SELECT *, coalesce(array_to_string(parts[1:a], ''), '') AS pre, coalesce(array_to_string(parts[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(parts[b + 1:n], ''), '') AS suf
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM split
"""
