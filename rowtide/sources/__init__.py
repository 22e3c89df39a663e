"""Row-change sources."""
