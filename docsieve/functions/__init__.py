"""Column functions: paths into documents, time, globs, identifiers and text."""
