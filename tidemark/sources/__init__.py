"""Readers and writers: JSONL with provenance, manifests, index and report sinks."""
