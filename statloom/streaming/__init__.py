"""Masking on streams: the masks are row expressions, so they run unchanged on readStream."""
