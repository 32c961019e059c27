"""Language by compression: the dictionary of the right language makes a text smallest.

Learning takes, for each language, a bounded sample of labelled rows: some characters of SAMPLE_ROWS rows, at
places that a hash decides, one after the other. They are the raw content of a zstandard dictionary. Prediction
lower-cases a text, turns everything but letters and marks into single spaces, cuts it into pieces of
PIECE_BYTES and encodes each piece with every dictionary. All pieces of a text count, and as each starts from the
dictionary alone, a long text is judged by its language throughout and not by its own repetitions. The smallest
total wins; among equal totals the language with more labelled rows, then the smaller name. The score is the
share by which the runner-up is larger, from 0 to 1; a text whose score is below MARGIN is not accepted.

Counts cover all labelled rows; the sample is drawn by hash, its expected size before the last cut being four
times SAMPLE_ROWS per language, and copies of a row being one row of it, so no task gathers a hot language. Prediction does not shuffle.

Defined cases: a null text, one without a letter, and any text if nothing was learned is `und` with score 0, not
accepted; a single learned language wins with score 1; rows with a null label, or a null condition to learn, teach
nothing; labels beyond the LANGUAGES most frequent are not learned; repeated rows count each; an empty table gives
an empty result; other columns are not read. A very long text must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import slices

SAMPLE_ROWS = 128
SAMPLE_CHARS = 500
LANGUAGES = 256
PIECE_BYTES = 4096
LEVEL = 6
MARGIN = 0.02

UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-case words of letters and marks, separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


@dataclass(frozen=True)
class Model:
    """Dictionary content by language, languages with more labelled rows first."""

    content: dict[str, bytes]

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for language, content in self.content.items():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            out[language] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        return out


def learn(docs: DataFrame, may_learn: Column, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Model:
    """Dictionaries from rows (doc_id, text, lang) where `may_learn` holds.

    At most `languages` counts and `languages * sample_rows * sample_chars` characters reach the driver.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", place.alias("_place"))
    counted = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counted:
        return Model({})
    ends = F.lit(None).cast("long")
    for r in counted:
        share = min(1.0, 4 * sample_rows / r["count"])
        ends = F.when(F.col("lang") == r["lang"], F.lit(int(share * (1 << 40)))).otherwise(ends)
    room = F.greatest(F.char_length("text") - sample_chars, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("_place"), room).cast("int") + 1
    drawn = labelled.where(F.col("_place") < ends).select("lang", "_place", letters(F.substring("text", begin, F.lit(sample_chars))).alias("part")).distinct()
    # the smallest places, as pairs in order; the rest of a language is a few times as many
    parts = drawn.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("_place", "part"))), 1, sample_rows).alias("parts"))
    content = {r["lang"]: "\n".join(p["part"] for p in r["parts"]).encode() for r in parts.collect()}
    return Model({r["lang"]: content[r["lang"]] for r in counted if content.get(r["lang"])})


def sizes(text: bytes, compressors: dict[str, zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text in pieces, by each compressor."""
    pieces = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors.values()]


def identify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document, from its text alone."""

    def judge(text: str | None, names: list[str], compressors: dict) -> tuple[str, float]:
        if text is None or not names:
            return UNKNOWN, 0.0
        ordered = sorted(zip(sizes(text.encode(), compressors), range(len(names)), strict=True))
        return names[ordered[0][1]], 1.0 if len(ordered) == 1 else 1.0 - ordered[0][0] / ordered[1][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        names = list(compressors)
        for batch in slices(batches, "text"):
            out = [judge(t, names, compressors) for t in batch.column("text").to_pylist()]
            found, score = zip(*out, strict=True)
            accepted = [n != UNKNOWN and s >= margin for n, s in out]
            arrays = [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "accepted"])

    text = F.when(F.col("text").rlike(r"\p{L}"), letters(F.col("text"))).alias("text")
    schema = "doc_id long, lang_pred string, score double, accepted boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, schema)
