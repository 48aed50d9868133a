"""Language identification by compression.

Each language has one zstandard raw-content dictionary, made of a bounded sample of its labelled documents. A text is
reduced to lower-case letters and single spaces, compressed with every dictionary, and belongs to the language whose
output is smallest. A narrow margin is a rejection.

Cases: null text or no letter gives ``und`` and score 0; ties go to the language with more documents; no labelled
document at all gives ``und`` for every text; a null id counts as the empty id; repeated rows give repeated results;
other columns are ignored. Whole texts are compressed, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import batch, id_remainder, map_batches, table

UNKNOWN = "und"
#: Fitting bounds: documents sampled for a language, characters of each, bytes of a dictionary, number of languages.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, MAX_LANGUAGES = 256, 4096, 400_000, 256
LEVEL = 3
#: Smallest share by which the best output must undercut the second for a confident answer.
MARGIN = 0.02
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters with one space for every run of other characters."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain.replace(" ", "").isalpha():  # numbers that are no decimal digits, such as fractions
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split(" ")).strip()
        plain = re.sub(" +", " ", plain)
    return plain.encode()


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, the language with most documents first."""

    contents: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list:
        import zstandard

        made = []
        for lang, content in self.contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)))
        return made


def fit(labelled: DataFrame) -> LanguageModel:
    """Dictionaries from rows (text, lang), neither null. The sample of a language is one document (the smallest
    hash) of each of ``SAMPLE_DOCS`` hash buckets, so it is bounded, deterministic and spread over all rows."""
    hashed = labelled.select("text", "lang", F.xxhash64("text").alias("h"))
    langs = [
        r.lang
        for r in hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    ]
    picked = (
        hashed.where(F.col("lang").isin(langs) if langs else F.lit(False))
        .groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("bucket"))
        .agg(F.min("h").alias("h"))
    )
    chosen = [r.h for r in picked.collect()]
    rows = (
        hashed.where(F.col("h").isin(chosen) & F.col("lang").isin(langs))
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
        .collect()
        if chosen
        else []
    )
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.h, letters(r.text)))
    contents = []
    for lang in [x for x in langs if x in by_lang]:
        content = b" ".join(x for _, x in sorted(by_lang[lang]) if x)[:DICT_BYTES]
        if len(content) >= 8:
            contents.append((lang, content))
    return LanguageModel(tuple(contents))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, confident) of every row (doc_id, text, held_out).

    ``score`` is the share of bytes by which the best output undercuts the second best; ``confident`` is false where
    that is under ``MARGIN``, which is how a caller rejects.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for rows in batches:
            preds, scores = [], []
            for text in rows.column("text").to_pylist():
                plain = letters(text) if text else b""
                if not plain or not compressors:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sizes = [(len(c.compress(plain)), k) for k, (_, c) in enumerate(compressors)]
                best = min(sizes)
                second = min((s for s in sizes if s is not best), default=(2 * best[0], 0))
                preds.append(compressors[best[1]][0])
                scores.append(1.0 - best[0] / second[0])
            yield batch(
                doc_id=rows.column("doc_id"),
                held_out=rows.column("held_out"),
                lang_pred=(preds, pa.string()),
                score=(scores, pa.float64()),
                confident=([s >= MARGIN for s in scores], pa.bool_()),
            )

    return map_batches(
        docs.select("doc_id", "text", "held_out"),
        task,
        "doc_id long, held_out boolean, lang_pred string, score double, confident boolean",
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    model = fit(docs.where(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    return identify(docs, model)
