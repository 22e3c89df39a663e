"""Row-change plans."""
