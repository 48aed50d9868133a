"""Line deduplication over overlapping three-line windows.

Lines with a word count, compared without surrounding white space. Every three consecutive such lines of a document are
a window; a window that occurs more than once anywhere keeps its first occurrence (smallest doc_id, then text hash,
then place), and the lines of all later occurrences go. Overlapping occurrences merge.

Cases: documents of fewer than three lines with a word have no window and stay whole; null text stays null; rows of
equal doc_id and text count as one document and are treated alike; rows without a doc_id come last, as one id; lines
without a word always stay; an empty table gives no rows; every other column, whatever its name, passes unchanged.
Windows are compared by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, fresh, map_batches, staged, table

SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
LAST_ID = (1 << 63) - 1


def content_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those with a word."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(SPACES)]


def windows(docs: DataFrame) -> DataFrame:
    """(h1, h2, id, th, pos) of every window of rows (id, th, text); pos counts the lines with a word."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows in batches:
            h1, h2, ids, ths, pos = [], [], [], [], []
            for i, th, text in zip(*(rows.column(k).to_pylist() for k in range(3))):
                lines, places = content_lines(text)
                plain = [lines[p].strip(SPACES) for p in places]
                for k in range(len(plain) - WINDOW + 1):
                    h = xxhash.xxh3_128_digest("\n".join(plain[k : k + WINDOW]).encode())
                    h1.append(int.from_bytes(h[:8], "big", signed=True))
                    h2.append(int.from_bytes(h[8:], "big", signed=True))
                    ids.append(i)
                    ths.append(th)
                    pos.append(k)
            long = pa.int64()
            yield batch(h1=(h1, long), h2=(h2, long), id=(ids, long), th=(ths, long), pos=(pos, pa.int32()))

    return map_batches(docs.where("text is not null"), task, "h1 long, h2 long, id long, th long, pos int")


def later_windows(found: DataFrame) -> DataFrame:
    """(id, th, places): per document, the windows that repeat an earlier one. ``found`` is read twice."""
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    repeats = found.join(first, ["h1", "h2"]).where(F.struct("id", "th", "pos") != F.col("first"))
    return repeats.groupBy("id", "th").agg(F.collect_set("pos").alias("places"))


def without_lines(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the lines of the windows at ``places``; removed lines and removed runs."""
    if not text or not places:
        return text, 0, 0
    lines, content = content_lines(text)
    gone = sorted({k + j for p in places for k, j in ((p, 0), (p, 1), (p, 2))})
    drop = {content[k] for k in gone}
    runs = sum(k == 0 or gone[k] != gone[k - 1] + 1 for k in range(len(gone)))
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(gone), runs


def drop_repeated_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any others) without repeated lines; if ``counts``, with n_removed_lines and n_spans."""
    id_, th = fresh(docs, "id__"), fresh(docs, "th__")
    places = fresh(docs, "places__")
    own_id: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    keyed = docs.withColumns({id_: own_id, th: F.xxhash64("text")})
    found = staged(windows(keyed.select(F.col(id_).alias("id"), F.col(th).alias("th"), "text").where("text is not null")), "windows")
    marks = later_windows(found).select(F.col("id").alias(id_), F.col("th").alias(th), F.col("places").alias(places))
    joined = keyed.join(marks, [id_, th], "left").select(*docs.columns, places)
    names = [fresh(docs, "n_removed_lines"), fresh(docs, "n_spans")] if counts else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.schema.get_field_index("text")
            marked = rows.column(rows.schema.get_field_index(places)).to_pylist()
            done = [without_lines(x, p) for x, p in zip(rows.column(at).to_pylist(), marked)]
            arrays = [a for a, n in zip(rows.columns, rows.schema.names) if n != places]
            arrays[at] = pa.array([d[0] for d in done], pa.string())
            arrays += [pa.array([d[k + 1] for d in done], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in rows.schema.names if n != places] + names)

    fields = [f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{n}` long" for n in names]
    return map_batches(joined, task, ", ".join(fields))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_removed_lines", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


#: The same over distinct doc_ids in SQL.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line, trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL) d,
  LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS i) u
), content AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE plain <> ''
), win AS (
  SELECT doc_id, pos, plain || chr(10) || lead(plain, 1) OVER w || chr(10) || lead(plain, 2) OVER w AS body
  FROM content WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS nth FROM win WHERE body IS NOT NULL
  ) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM later, (SELECT unnest([0, 1, 2]) AS o)
), runs AS (
  SELECT doc_id, count(*) AS n_removed_lines, sum(CASE WHEN prev IS NULL OR prev <> pos - 1 THEN 1 ELSE 0 END) AS n_spans
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS body
  FROM lines l LEFT JOIN content c ON c.doc_id = l.doc_id AND c.i = l.i
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = c.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(r.n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
  sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
