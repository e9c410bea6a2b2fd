"""Language by compression: the language whose sample text helps most to compress a document.

For each language, a raw-content zstandard dictionary is made of pieces of labelled documents:
of each of ``SLICES`` hash slices the document with the smallest hash, so any language gives at most that many
pieces (the bound of the sample). A text is lower-cased and cut into blocks, each is compressed with every
dictionary, and the language with the fewest bytes in total wins; equal sizes go to the first
name. Its lead over the next, by its own size, is the margin: documents with a
narrow margin are rejected. The score is the softmax of the sizes.

A null text or one without a letter is ``und`` with score 0 and rejected, and so is every text when nothing
is labelled; with one language, all others get it with score 1. Repeated rows are told alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.llm.common import joined, modulo, roomy, stored

SLICES = 256
#: Characters that each sampled document gives at most.
PIECE = 600
BLOCK = 2048
LEVEL = 3
MARGIN = 0.004
UNKNOWN = "und"


def samples(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", slices: int = SLICES) -> dict[str, bytes]:
    """The dictionary content of each language, from the rows given.

    The first pass reads no texts; the second fetches those chosen. What comes to the driver
    is ``slices`` pieces a language.
    """
    keyed = docs.select(F.col(lang).alias("l"), F.xxhash64(F.lit("language"), key).alias("h"), F.col(text).alias("text")).where("l is not null")
    chosen = keyed.groupBy("l", F.pmod("h", F.lit(slices)).alias("slice")).agg(F.min("h").alias("h")).select("l", "h")
    rows = joined(keyed, stored(chosen, "language"), ["l", "h"], "inner").where(F.col("text").rlike(r"\p{L}"))
    parts: dict[str, list[bytes]] = {}
    for r in rows.groupBy("l", "h").agg(F.min(F.lower(F.substring("text", 1, PIECE))).alias("t")).orderBy("l", "h").collect():
        parts.setdefault(r["l"], []).append(r["t"].encode())
    return {name: b"\n".join(parts[name]) for name in sorted(parts)}


def identify(docs: DataFrame, content: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), text: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """``keep`` of each row as ``row``, with lang_pred, score, margin and rejected."""
    names = list(content)
    lettered: Column = F.col(text).rlike(r"\p{L}")
    rows = docs.select(F.struct(*keep).alias("row"), F.when(lettered, F.lower(text).cast("binary")).alias("raw"))

    def sized(batches):
        import zstandard as zstd
        packers = []
        for name in names:
            held = zstd.ZstdCompressionDict(content[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            packers.append(zstd.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            found, scores, margins = [], [], []
            for raw in batch.column("raw"):
                body = raw.as_buffer()
                if body is None or not packers:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    margins.append(0.0)
                    continue
                view = memoryview(body)
                blocks = [view[i:i + BLOCK] for i in range(0, len(view), BLOCK)]
                size = np.array([sum(len(pack(b)) for b in blocks) for pack in packers], float)
                best = int(size.argmin())
                others = np.delete(size, best)
                found.append(names[best])
                scores.append(float(1 / np.exp(np.maximum(size[best] - size, -700)).sum()))
                margins.append(float((others.min() - size[best]) / size[best]) if len(others) else 1.0)
            yield pa.record_batch([batch.column("row"), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                                  names=["row", "lang_pred", "score", "margin"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, margin double"
    return rows.mapInArrow(roomy(sized), schema).withColumn("rejected", F.col("margin") < margin)


def known_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is told, with their own columns; learned from their own labels."""
    content = samples(docs.where(modulo(F.col("doc_id"), 3) != 1))
    return identify(docs, content, keep=tuple(docs.columns)).where(~F.col("rejected")).select("row.*")
