"""Operators of a training-data pipeline: tokenizers, filters, de-duplication, packing. Nothing outside imports this package."""
