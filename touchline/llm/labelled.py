"""Labelled rows: which are held out, and bounded samples to fit a classifier on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import whole_text

#: Rows of more bytes than this are not drawn into a sample, which bounds the sample's bytes.
MAX_SAMPLE_ROW_BYTES = 128 << 10


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether a row is held out of learning; a row without an id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, rows: int, by_class: bool,
           text: str = "text", key: str = "doc_id") -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts (of each class if ``by_class``), in the order of a hash of the id.

    The ids are chosen first, from the labels alone, so what is broadcast and collected is bounded by
    ``rows``.  A document with both labels counts as 1; its rows share the label.
    """
    known = (labels.where(F.col(label).isin(0, 1)).where(learnable).groupBy(F.col(key).alias("_label_id")).agg(F.max(label).alias("_label"))
             .where("_label_id is not null"))
    order = F.xxhash64("_label_id", F.lit(7))
    if by_class:
        chosen = known.where("_label = 0").orderBy(order, "_label_id").limit(rows).unionAll(known.where("_label = 1").orderBy(order, "_label_id").limit(rows))
    else:
        chosen = known.orderBy(order, "_label_id").limit(rows)
    source = docs.select(F.col(key).alias("_label_id"), whole_text(text).alias("_text")).where(F.octet_length("_text") <= MAX_SAMPLE_ROW_BYTES)
    found = source.join(F.broadcast(chosen), "_label_id").select("_label_id", "_text", "_label").distinct()
    picked = found.orderBy(F.xxhash64("_label_id", F.lit(7)), "_label_id", F.xxhash64("_text")).limit(2 * rows if by_class else rows).collect()
    return [(r["_text"], int(r["_label"])) for r in picked]
