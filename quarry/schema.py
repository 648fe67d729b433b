"""Schemas of the tables."""

FRAGMENTS = "source STRING, page_label STRING, page_number STRING, page STRING, fragment_no BIGINT, fragment STRING"
CHUNKS = "id STRING, context STRING, text STRING, source STRING, page INT, geo ARRAY<STRING>, metrics ARRAY<STRING>, years ARRAY<INT>, time_granularity STRING, oked STRING"
STORE = CHUNKS + ", pos BIGINT, chunk_type STRING, embedding ARRAY<FLOAT>"
QUERIES = "query_id BIGINT, query STRING, embedded_query ARRAY<FLOAT>, geo ARRAY<STRING>, metrics ARRAY<STRING>, years ARRAY<INT>, time_granularity STRING, oked STRING, raw_response STRING"
FAILURES = "event STRING, error_type STRING, pdf_name STRING, chunk_id STRING, page INT, attempts INT, chunk_text STRING, system_prompt STRING, prompt STRING, raw_response STRING, ts DOUBLE"
DICTIONARY = "word STRING, freq BIGINT"
