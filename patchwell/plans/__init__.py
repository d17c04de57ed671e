"""End-to-end review jobs and the query registry."""
