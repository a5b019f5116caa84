"""Structured Streaming counterparts: delivery, blocking queues, expiry."""
