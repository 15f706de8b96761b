"""Names, period labels and output ids.

An output id reads ``<cat>_<dept no>_<item no>_<state>_<store no>_<stage>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stage names, the states and categories recognised inside an id with the
# fallback used when none matches, and the order of categories in the output file.
STAGES = ("validation", "evaluation")
STATE_TOKENS, OTHER_STATE = ("CA", "TX"), "WI"
CATEGORY_TOKENS, OTHER_CATEGORY = ("HOBBIES", "HOUSEHOLD"), "FOOD"
CATEGORY_ORDER = ("HOBBIES", "HOUSEHOLD", "FOOD")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_name(*cols: Column | str) -> Column:
    """Key columns joined by ``_``."""
    return F.concat_ws("_", *[_col(c) for c in cols])


def period_index(label: Column | str) -> Column:
    """``d_17`` or ``F17`` -> 17."""
    return F.regexp_extract(_col(label), r"(\d+)$", 1).cast("int")


def horizon_label(h: Column | str) -> Column:
    """1 -> ``F1``."""
    return F.concat(F.lit("F"), _col(h).cast("string"))


def day_label(d: Column | str) -> Column:
    """17 -> ``d_17``."""
    return F.concat(F.lit("d_"), _col(d).cast("string"))


def make_id(item: Column | str, store: Column | str, stage: str) -> Column:
    return F.concat_ws("_", _col(item), _col(store), F.lit(stage))


def strip_stage(c: Column | str) -> Column:
    """Drop every stage suffix from an id or node name."""
    return F.regexp_replace(_col(c), "_" + "|_".join(STAGES), "")


def restage(c: Column | str, to: str = "evaluation", old: str = "validation") -> Column:
    """Swap the stage at the end of an id; other occurrences stay."""
    return F.regexp_replace(_col(c), old + "$", to)


def _first_hit(text: Column, tokens: tuple[str, ...], pattern: str, other: str) -> Column:
    hit = F.lit(other)
    for token in reversed(tokens):
        hit = F.when(text.contains(pattern.format(token)), F.lit(token)).otherwise(hit)
    return hit


def parse_id(c: Column | str) -> dict[str, Column]:
    """State, category, item, store and stage of an output id, as named columns."""
    c = _col(c)
    tokens = F.split(c, "_")
    return {
        "state_id": _first_hit(c, STATE_TOKENS, "_{}_", OTHER_STATE),
        "cat_id": _first_hit(c, CATEGORY_TOKENS, "{}_", OTHER_CATEGORY),
        "item_id": F.array_join(F.slice(tokens, 1, 3), "_"),
        "store_id": F.array_join(F.slice(tokens, 4, 2), "_"),
        "stage": F.element_at(tokens, -1),
    }


def rank_in(c: Column | str, order: tuple[str, ...]) -> Column:
    """Position of a value in ``order`` (1-based, 0 when absent)."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), _col(c)).cast("int")
