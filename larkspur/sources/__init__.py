"""Table readers and writers."""

from larkspur.sources.bucketed import bucket_count, exchanges, write_bucketed
from larkspur.sources.formats import FORMATS, read_files, write_table
from larkspur.sources.logs import register_logs, write_logs
from larkspur.sources.scratch import scratch
from larkspur.sources.tables import TABLES, read_table

__all__ = ["bucket_count", "FORMATS", "TABLES", "exchanges", "read_files", "read_table", "register_logs", "scratch", "write_bucketed", "write_logs", "write_table"]
