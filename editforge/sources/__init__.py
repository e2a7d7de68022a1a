"""Sources and sinks: parquet test tables, JSONL shards, fixture views."""
