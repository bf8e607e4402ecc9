"""UD9: where an installation keeps its things, and what it asks for; from the session's settings, with defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Folders, addresses of outside services, and limits of the evidence search."""

    data_dir: str = "data"
    models_dir: str = "models"
    graphql_url: str = ""
    citation_url: str = ""
    own_evidences: int = 30
    corpus_evidences: int = 10

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """What spark.tabulith.<name> says, else the default."""
        found = {f.name: spark.conf.get(f"spark.tabulith.{f.name}", None) for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{name: kinds[name](value) for name, value in found.items() if value is not None})
