"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DEGREE = _struct(
    name=_S, price=_L, currency=_S, course_type=_S, is_online=_B, limit=_S, context=_S, tuition_type=_S, amount_min=_L,
    amount_max=_L, normalized_monthly_amount=_D, normalization_note=_S,
)
TAG_HIT = _struct(tag_name=_S, course_type=_S, keyword=_S, hit_count=_I, weight=_I, weighted_score=_I)
TAG_CLASS = _struct(tag_name=_S, class_name=_S, occurrence_count=_I)
PAGE_RECORD = _struct(
    url=_S, title=_S, country=_S, timestamp=_S, degrees=T.ArrayType(DEGREE), tag_keyword_hits=T.ArrayType(TAG_HIT),
    tag_class_counts=T.ArrayType(TAG_CLASS), raw_text=_S, source_type=_S, domain=_S, degree_count=_L,
)
LOAD_RECORD = T.StructType([f for f in PAGE_RECORD if f.name in ("url", "title", "timestamp", "country", "degrees")])
TASK = _struct(run_id=_L, url=_S, depth=_I, domain=_S, discovered_from=_S)
ACCESS = _struct(
    recv_ts=_D, send_ts=_D, host=_S, method=_S, path=_S, user_agent=_S, client_ip=_S, status=_I, response_type=_S,
    response_bytes=_L, injected_delay_ms=_I, outcome=_S, run_label=_S,
)
DOMAINS = _struct(host=_S, profile=_S, crawl_delay=_I, robots_status=_S)
PAGES = _struct(host=_S, path=_S, status=_S, reachable=_S)
WORKERS = _struct(client_ip=_S, worker_id=_S)
RESOURCES = _struct(
    timestamp=_S, elapsed_sec=_D, process_cpu_percent=_D, process_rss_mb=_D, system_cpu_percent=_D, system_memory_percent=_D
)
QUEUE_EVENT = _struct(
    kind=_S, run_id=_L, url=_S, parent_url=_S, domain=_S, depth=_I, status=_S, fetch_method=_S, worker_id=_S,
    source=_S, tag_name=_S, class_name=_S, course_type=_S, keyword=_S, count=_L, score=_L, ok=_B, error_type=_S, at=T.TimestampType(),
)
GATE_ROW = _struct(
    source_url=_S, source_page_type=_S, hit_count=_S, root_seed_urls=_S, detailed_seed_urls=_S, errors=_S, api_usage_count=_S
)
