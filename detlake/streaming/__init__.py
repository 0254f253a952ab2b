"""Incremental ingestion of detections."""
