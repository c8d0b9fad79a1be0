"""Tables, enumerations and settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
_VEC = T.ArrayType(T.FloatType())


def _table(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


#: Stored tables.  Metadata, settings and properties are JSON strings at rest.
TABLES: dict[str, T.StructType] = {
    "namespaces": _table(name=_S, embedding_model=_S, llm_provider=_S, settings=_S, created_at=_TS),
    "documents": _table(id=_S, namespace=_S, source=_S, content_hash=_S, title=_S, metadata=_S, ingested_at=_TS),
    "chunks": _table(id=_S, namespace=_S, document_id=_S, ord=_I, text=_S, token_count=_I, embedding=_VEC, metadata=_S),
    "entities": _table(id=_S, namespace=_S, name=_S, kind=_S, name_emb=_VEC, description=_S, properties=_S),
    "relationships": _table(id=_S, namespace=_S, src_id=_S, dst_id=_S, kind=_S, description=_S, weight=_D),
    "chunk_entities": _table(chunk_id=_S, entity_id=_S, confidence=_D, classification=_S),
    "postings": _table(namespace=_S, lexeme=_S, chunk_id=_S, tf=_L, positions=T.ArrayType(_I)),
    "vector_lists": _table(list=_I, id=_S, namespace=_S, embedding=_VEC),
    "centroids": _table(list=_I, centroid=T.ArrayType(_D), probes=_I),
    "providers": _table(name=_S, kind=_S, provider=_S, model=_S, base_url=_S, credential=_S),
    "ingest_jobs": _table(
        id=_S, status=_S, source=_S, namespace=_S, chunk_strategy=_S, error=_S, attempt_count=_I, payload=T.BinaryType(),
        enqueued_at=_TS, started_at=_TS, finished_at=_TS, updated_at=_TS,
    ),
}

#: Order of a table's files, so that their statistics let scans skip most of them.
SORTED: dict[str, tuple[str, ...]] = {"vector_lists": ("namespace", "list"), "postings": ("namespace", "lexeme"), "chunks": ("namespace", "document_id"), "chunk_entities": ("entity_id",)}

#: Columns that a table may hold only once; null parts never conflict.
UNIQUE: dict[str, tuple[str, ...]] = {
    "namespaces": ("name",),
    "providers": ("name",),
    "documents": ("namespace", "content_hash"),
    "chunks": ("document_id", "ord"),
    "entities": ("namespace", "name", "kind"),
    "relationships": ("namespace", "src_id", "dst_id", "kind"),
    "chunk_entities": ("chunk_id", "entity_id"),
    "ingest_jobs": ("id",),
}


class Mode(Enum):
    """Which lanes a query ranks by.  Names are case-sensitive; others are an error."""

    HYBRID = "hybrid"
    VECTOR = "vector"
    BM25 = "bm25"
    GRAPH = "graph"

    @classmethod
    def parse(cls, name: str) -> "Mode":
        try:
            return cls(name)
        except ValueError:
            raise InvalidConfig(f"unknown mode {name!r}; known: {', '.join(m.value for m in cls)}") from None

    @property
    def lanes(self) -> tuple[str, ...]:
        return {"hybrid": ("vec", "bm25", "graph"), "vector": ("vec",), "bm25": ("bm25",), "graph": ("graph",)}[self.value]


class Status(Enum):
    QUEUED = "queued"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"


#: Parallel extraction of each ingest profile.
PROFILES = {"conservative": 2, "balanced": 4, "aggressive": 8, "max": 16}


def profile_concurrency(name: str) -> int:
    if name not in PROFILES:
        raise InvalidConfig(f"unknown ingest profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name]


class CoreError(Exception):
    """Base of the engine's errors."""


class NamespaceNotFound(CoreError):
    pass


class ProviderNotFound(CoreError):
    pass


class InvalidConfig(CoreError):
    pass


class Conflict(CoreError):
    """Another writer published first."""


class CryptoError(CoreError):
    pass


class LlmError(CoreError):
    pass


class HttpError(CoreError):
    """A provider's HTTP failure; ``retry`` says whether another attempt may help."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"HTTP {status} {message}".strip())
        self.status, self.retry = status, status == 429 or status >= 500


@dataclass(frozen=True)
class Settings:
    """Engine settings with the bounds of each."""

    embed_dim: int = 384
    extract_concurrency: int = 4
    job_reaper_interval: int = 300
    max_attempts: int = 3
    exact: bool = True
    debug_retrieval: bool = False

    def __post_init__(self) -> None:
        for name, low, high in (("embed_dim", 64, 4096), ("extract_concurrency", 1, 64), ("job_reaper_interval", 10, 86_400), ("max_attempts", 1, 100)):
            if not low <= getattr(self, name) <= high:
                raise InvalidConfig(f"{name} is from {low} to {high}")


#: Retrieval constants.
RRF_K = 60
LANE_LIMIT = 50
SEED_LIMIT = 8
SEED_DISTANCE = 0.35
#: Entity resolution thresholds.
TRIGRAM_THRESHOLD = 0.85
COSINE_THRESHOLD = 0.90
CANDIDATE_LIMIT = 8
#: Characters that an answer's context may take by default, in tokens.
DEFAULT_BUDGET = 4000
