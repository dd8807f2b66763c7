"""What a new chunking of documents changes: chunks that stay, move, come and go, so that only new ones are embedded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, old_place, new_place, change) of chunks old and new (document_id, place, content); a chunk is known by document and place.

    The nth chunk of a content is matched with the nth of the same content in the document; chunks without content (null) are
    alike. A matched chunk is kept (at its place), shifted (in the document's longest run of consecutive chunks that changed
    places together, the first if several are as long) or moved; others are added or removed. Places count from 0.

    Chunks are shuffled once, as places and digests of 16 bytes, by document; a document's are in one task, as its text was.
    """
    digest = F.unhex(F.substring(F.sha2("content", 256), 1, 32)).alias("digest")
    side = lambda df, fresh: df.select("document_id", F.lit(fresh).alias("fresh"), "place", digest)
    rows = side(old, False).unionByName(side(new, True)).repartition("document_id")
    within = lambda *by: Window.partitionBy("document_id", *by)
    numbered = rows.withColumn("nth", F.row_number().over(within("fresh", "digest").orderBy("place")))
    place = lambda fresh, name: F.max(F.when(F.col("fresh") == fresh, F.col("place"))).alias(name)
    met = numbered.groupBy("document_id", "digest", "nth").agg(place(False, "old_place"), place(True, "new_place")).withColumn("shift", F.col("new_place") - F.col("old_place"))
    islands = met.withColumn("island", F.col("new_place") - F.row_number().over(within("shift").orderBy("new_place")))
    run = F.struct(F.count("*").over(within("shift", "island")).alias("length"), (-F.min("new_place").over(within("shift", "island"))).alias("low"))
    sized = islands.withColumn("run", F.when(F.col("shift") != 0, run))
    together = F.col("run") == F.max("run").over(within())
    change = F.when(F.col("old_place").isNull(), "added").when(F.col("new_place").isNull(), "removed").when(F.col("shift") == 0, "kept").when(together, "shifted").otherwise("moved")
    return sized.select("document_id", "old_place", "new_place", change.alias("change"))


def carried(new: DataFrame, changed: DataFrame, old: DataFrame) -> DataFrame:
    """The chunks new(document_id, place, content) with the embedding of the chunk of old(document_id, place, embedding) that each was; null for added ones."""
    known = changed.filter(F.col("old_place").isNotNull() & F.col("new_place").isNotNull())
    vectors = known.join(old.select("document_id", F.col("place").alias("old_place"), "embedding"), ["document_id", "old_place"])
    return new.select("document_id", "place", "content").join(vectors.select("document_id", F.col("new_place").alias("place"), "embedding"), ["document_id", "place"], "left")
