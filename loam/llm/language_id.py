"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary of sample text, in lower case. A text in
lower case belongs to the language whose dictionary compresses it to the fewest bytes. The score is the margin,
1 - smallest / second smallest (0 to 1); a prediction with a margin under `min_margin` is marked
rejected.

Defined results: null texts and texts without a letter give `und`, score 0, not rejected. Ties go to the
language that sorts first. With one learned language the score is 1; with none every text is `und`.
Repeated rows are scored one by one, and learned from once; extra columns are ignored. Texts are compressed
whole, however long. Without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table

#: Characters of sample text in a dictionary, and in each slice of a training document taken into it.
DICTIONARY_CHARS = 160_000
SLICE_CHARS = 2_000
MIN_MARGIN = 0.01
LEVEL = 9


def train_dictionaries(labelled: DataFrame, dictionary_chars: int = DICTIONARY_CHARS, slice_chars: int = SLICE_CHARS) -> dict[str, bytes]:
    """One dictionary a language from labelled(doc_id, text, lang).

    The fit takes a bounded random sample: about dictionary_chars / slice_chars different documents of
    each language, drawn by a hash of doc_id and text, and of each a slice from its middle. The share to
    draw of each language, a row a language, goes into the filter, so only what is drawn is shuffled.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = usable.groupBy("lang").agg((F.sum(F.least(F.length("text"), F.lit(slice_chars))) / slice_chars).alias("slices")).collect()
    if not sizes:
        return {}
    wanted = 1.5 * dictionary_chars / slice_chars
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], wanted / r["slices"])))
    draw = F.xxhash64(F.lit("language"), "doc_id", "text")
    middle = F.greatest(F.lit(1), ((F.length("text") - slice_chars) / 2).cast("int"))
    drawn = usable.filter(F.pmod(draw, F.lit(1 << 30)) / (1 << 30) < F.element_at(share, F.col("lang")))
    pieces = drawn.select("lang", draw.alias("draw"), F.lower(F.substring("text", middle, F.lit(slice_chars))).alias("piece"))
    rows = pieces.groupBy("lang", "draw").agg(F.min("piece").alias("piece")).collect()  # repeated rows once
    parts: dict[str, list[str]] = {}
    for lang, _, piece in sorted(rows):
        parts.setdefault(lang, []).append(piece)
    return {lang: "\n".join(pieces)[-dictionary_chars:].encode() for lang, pieces in sorted(parts.items())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Columns of `keep`, lang_pred, score and rejected for each row of docs(text, *keep)."""
    names = list(dictionaries)
    source = docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=content, write_checksum=False))
        for batch in batches:
            found, scores, rejected = [], [], []
            letters = batch.column("_letters").to_pylist()
            for has, text in zip(letters, batch.column("_text"), strict=True):
                if not has or not names:
                    found.append("und"), scores.append(0.0), rejected.append(False)
                    continue
                raw = text.as_py().encode()
                sizes = sorted((len(p.compress(raw)), name) for p, name in zip(packers, names, strict=True))
                margin = 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                found.append(sizes[0][1]), scores.append(margin), rejected.append(margin < min_margin)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"],
            )

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    dictionaries = train_dictionaries(docs.filter(~held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return classify(scored, dictionaries, ["doc_id", "held_out"])
