"""Content addressing shared by the operators that keep results per distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A staged table of at most this many digests (about 100 bytes each) may be broadcast; beyond
# it texts are grouped first and joined on their digest.
BROADCAST_ROWS = 50_000


def digest(text_col):
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text_col, F.lit("")), 256)


def one_text_each(keyed: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """One (key, text) for each key of ``wanted``, a staged table of distinct keys.

    Copies are combined where they are read, so a text that a third of all rows hold is shipped
    once per task. A small ``wanted`` is broadcast first, then only its texts move at all.
    """
    rows = keyed.select(key, text)
    if wanted.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), key, "left_semi").groupBy(key).agg(
            F.first(text).alias(text))
    return rows.groupBy(key).agg(F.first(text).alias(text)).join(wanted, key, "left_semi")
