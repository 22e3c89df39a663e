"""Row-change operators."""
