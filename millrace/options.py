"""The pipeline's settings with their defaults, to be given whole or changed one by one, or read from a session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "spark.millrace."


@dataclass(frozen=True)
class Options:
    shortest: int = 800  # characters of a chunk
    longest: int = 1200
    overlap: int = 200
    sections: bool = True  # section lines end pieces
    visibility: str = "snapshot"  # whom the duplicate rules see: "snapshot" or "as_of"
    embedding_model: str = "hashed"
    dimension: int = 1024
    top_k: int = 8
    chat_top_k: int = 8

    def __post_init__(self) -> None:
        if not 0 <= self.overlap or not 0 <= self.shortest <= self.longest or self.longest < 1 or self.dimension < 1 or not 1 <= self.top_k <= 20 or not 1 <= self.chat_top_k <= 20:
            raise ValueError(f"these do not go together: {self}")
        if self.visibility not in ("snapshot", "as_of"):
            raise ValueError(f"visibility is snapshot or as_of, not {self.visibility}")

    @property
    def chunking(self) -> dict[str, object]:
        """The settings of operators.chunking."""
        return {"shortest": self.shortest, "longest": self.longest, "overlap": self.overlap, "sections": self.sections}


def of(spark: SparkSession, **changes: object) -> Options:
    """The defaults, with the session's settings of spark.millrace.<name> and then the changes."""
    set_ = {}
    for f in fields(Options):
        if (value := spark.conf.get(PREFIX + f.name, None)) is not None:
            kind = type(f.default)
            set_[f.name] = value.lower() == "true" if kind is bool else kind(value)
    return replace(Options(**set_), **changes)
