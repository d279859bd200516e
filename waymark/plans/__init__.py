"""Multi-step jobs and the registered queries with their SQL checks."""
