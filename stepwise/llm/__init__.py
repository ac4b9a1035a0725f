"""Operators of a training-data pipeline: language, leaks, HTML, copies, quality, secrets, shards, archives, PII, mixing."""
