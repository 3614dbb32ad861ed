"""Structured Streaming: tensors appended to a container."""
