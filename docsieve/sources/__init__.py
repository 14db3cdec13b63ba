"""Bucket storage: where a bucket's data lies, how it is scanned and how it is written."""
