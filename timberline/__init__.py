"""Log analytics as DataFrame operators on Spark."""

from timberline.operators.anomalies import rate_anomalies
from timberline.operators.chunks import anchored_chunks, pack_chunks, sliding_chunks, time_chunks
from timberline.operators.compress import compress_logs, quick_compress
from timberline.operators.diff import diff_logs, diff_templates
from timberline.operators.filters import entry_filter, search_filter, tail_filter
from timberline.operators.parse import detect_format, parse_logs
from timberline.operators.prompts import build_prompts
from timberline.operators.redact import redact_column, redact_entries, redacted_values
from timberline.operators.search import count_matches, last_entries, search, search_context
from timberline.operators.stats import compute_stats, group_by, level_counts, top_messages
from timberline.operators.templates import mine_templates, template_frequency
from timberline.operators.vectors import build_index
from timberline.operators.windows import time_windows, window_levels
from timberline.session import configure
from timberline.sources.text import read_lines, read_logs
from timberline.streaming.appended import follow_appended
from timberline.streaming.follow import follow_logs, tail, tail_and_follow
from timberline.streaming.stateful import stream_templates, stream_windows

__all__ = [
    "anchored_chunks", "build_index", "build_prompts", "compress_logs", "compute_stats",
    "configure", "count_matches", "detect_format", "diff_logs", "diff_templates",
    "entry_filter", "follow_appended", "follow_logs", "group_by", "last_entries",
    "level_counts", "mine_templates", "pack_chunks", "parse_logs", "quick_compress",
    "rate_anomalies", "read_lines", "read_logs", "redact_column", "redact_entries",
    "redacted_values", "search", "search_context", "search_filter", "sliding_chunks",
    "stream_templates", "stream_windows", "tail", "tail_and_follow", "tail_filter",
    "template_frequency", "time_chunks", "time_windows", "top_messages", "window_levels",
]
