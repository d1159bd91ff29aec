"""Structured Streaming jobs and their batch counterparts."""
