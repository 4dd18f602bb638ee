"""Structured Streaming: mutation logs folded into rectangles as they arrive."""
