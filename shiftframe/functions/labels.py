"""Names for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of feature names and what readers see for them, in this order.
SHORT = (("diff_", "Δ "), ("cf_percent", "CF%"), ("fo_percent", "FO%"), ("cf60", "CF/60"), ("ca60", "CA/60"), ("toi_es_sec", "ES TOI"), ("_", " "))


def feature_label(feature: Column, roles: dict[str, str], window: int = 15) -> Column:
    """A feature's name for readers: role shares by the role's label (``roles``, by position and number), others spelt out."""
    base = F.replace(feature, F.lit(f"roll{window}_"), F.lit(""))
    position, number = (F.regexp_extract(base, r"([FD])_share_(\d+)", k) for k in (1, 2))
    key = F.concat(position, number)
    role = F.try_element_at(F.create_map(*(F.lit(x) for pair in roles.items() for x in pair)), key)
    plain = base
    for part, short in SHORT:
        plain = F.replace(plain, F.lit(part), F.lit(short))
    return F.when(key != "", F.concat(position, F.lit(": "), F.coalesce(role, key))).otherwise(plain)
