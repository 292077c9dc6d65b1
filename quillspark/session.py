"""Session builder and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


def build_session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_YES = frozenset("1 true yes on".split())


@dataclass
class Settings:
    """Tunable values. Text settings take the argument, then the environment, then the default; numbers prefer the
    environment even over an argument."""

    db_path: str = "./quill_db"
    storage_dir: str = "./quill_files"
    embedding_provider: str = "deterministic"
    embedding_model: str = ""
    embedding_url: str = ""
    summary_model: str = ""
    rerank_enabled: bool = False
    rerank_provider: str = "lexical"
    rerank_model: str = ""
    rerank_url: str = ""
    rerank_top_n: int = 10
    rerank_multiplier: float = 1.0
    rerank_weight: float = 0.85
    search_heat_weight: float = 0.0
    section_heat_half_life: float = 86_400.0
    section_heat_threshold: float = 5.0
    section_heat_max_entries: int = 1000
    access_recent_size: int = 200
    access_hot_size: int = 50
    max_concurrent_tasks: int = 5
    chunk_target_tokens: int = 1000

    def __post_init__(self) -> None:
        for f in fields(self):
            env = os.environ.get("QUILL_" + f.name.upper())
            if env is None:
                continue
            kind = type(f.default)
            if kind is str:
                if getattr(self, f.name) == f.default:
                    setattr(self, f.name, env)
            else:
                setattr(self, f.name, (env.lower() in _YES if kind is bool else kind(env)))
        self.section_heat_half_life = max(1.0, self.section_heat_half_life)
        self.section_heat_max_entries = max(1, self.section_heat_max_entries)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local temporary one only in local mode with none set."""
    import tempfile
    import uuid

    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return f"{told.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillspark-")
