"""Byte entropy of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that are counted at once.
_STEP = 1 << 16


def _counts(data: Column) -> Column:
    """How often each byte that occurs does, in ascending order."""

    @F.arrow_udf("array<int>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for raw in rows:
            own = np.frombuffer(raw.as_buffer(), np.uint8)
            n = np.zeros(256, np.int64)
            for a in range(0, len(own), _STEP):
                n += np.bincount(own[a : a + _STEP], minlength=256)
            out.append(np.sort(n[n > 0]))
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]), pa.int32()))

    return of(data)


def byte_entropy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, entropy in bits, n_tokens, max_entropy, ratio (null for one symbol), a row a text.
    Null and empty texts have entropy 0.  The bytes are counted within the row, so nothing is
    exploded or shuffled."""
    rows = docs.select(id_col, _counts(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")).alias("counts"))
    rows = rows.withColumn("total", F.aggregate("counts", F.lit(0), lambda a, n: a + n))
    plogp = F.aggregate("counts", F.lit(0.0), lambda a, n: a + n * F.log2(n))
    entropy = F.when(F.col("total") > 0, F.log2("total") - plogp / F.col("total")).otherwise(0.0)
    kinds = F.size("counts").cast("long")
    most = F.when(kinds > 0, F.log2(kinds)).otherwise(0.0)
    rounded = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zero
    return rows.select(id_col, rounded(F.abs(entropy)).alias("entropy"), kinds.alias("n_tokens"), rounded(most).alias("max_entropy"), rounded(F.when(most > 0, F.abs(entropy) / most)).alias("ratio"))
