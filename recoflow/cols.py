"""Role-based column names (user, item, rating, timestamp, prediction)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Cols:
    user: str = "user_id"
    item: str = "item_id"
    rating: str = "rating"
    timestamp: str = "ts"
    prediction: str = "prediction"
    label: str = "label"

    def with_(self, **kw) -> "Cols":
        return replace(self, **kw)


DEFAULT = Cols()


def require(df, *names: str, what: str = "data") -> None:
    """Raise when a role column is missing (schema check, no Spark job)."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"{what} lacks {', '.join(absent)}; it has {', '.join(df.columns)}")
