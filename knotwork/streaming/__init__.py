"""Structured Streaming over a repository: its log, its search index, its replicas."""
