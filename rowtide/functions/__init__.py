"""Row-change functions."""
