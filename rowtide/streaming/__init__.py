"""Row-change streaming."""
