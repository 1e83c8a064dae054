"""A document-text engine for Spark: parsing, guards, reading order, repair, rendering, scoring and job queues."""
