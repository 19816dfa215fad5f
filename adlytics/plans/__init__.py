"""End-to-end analyses, one registered query per flow (see registry)."""
