"""End-to-end jobs that combine sources, operators and sinks."""
