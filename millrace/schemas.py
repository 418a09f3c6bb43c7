"""Schemas of the tables; nothing is inferred."""

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


PAGES = _struct(doc_id=_S, page_number=_I, text=_S)
DATASETS = _struct(tenant_id=_S, dataset_id=_S, name=_S, status=_S, created_at=_TS, updated_at=_TS)
FILES = _struct(tenant_id=_S, dataset_id=_S, file_id=_S, filename=_S, content_type=_S, raw_key=_S, size_bytes=_L, raw_sha256=_S, simhash=_L, status=_S, latest_job_id=_S, created_at=_TS, updated_at=_TS)
JOBS = _struct(tenant_id=_S, file_id=_S, job_id=_S, dataset_id=_S, status=_S, created_at=_TS, started_at=_TS, finished_at=_TS, error_message=_S, readiness_score=_I, findings_summary=T.MapType(_S, _I), artifacts=T.MapType(_S, _S))
CHUNKS = _struct(
    tenant_id=_S, dataset_id=_S, doc_id=_S, chunk_id=_S, source_uri=_S, filename=_S, page=_I, chunk_index=_I, text=_S, embedding=T.ArrayType(T.FloatType()), content_hash=_S, embedding_model=_S,
    acl=T.ArrayType(_S), created_at=_TS, doc_type=_S, doc_type_confidence=_D, discipline=_S, section_reference=_S, standards_referenced=T.ArrayType(_S),
)
CITATION = _struct(chunk_id=_S, filename=_S, page=_I, score=_D, snippet=_S, doc_id=_S)
MESSAGES = _struct(tenant_id=_S, conversation_id=_S, created_at=_TS, message_id=_S, role=_S, content=_S, citations=T.ArrayType(CITATION))
AUDIT = _struct(tenant_id=_S, created_at=_TS, event_id=_S, type=_S, metadata=T.MapType(_S, _S))
#: What Spark's binaryFile source gives.
RAW_FILES = _struct(path=_S, modificationTime=_TS, length=_L, content=T.BinaryType())
