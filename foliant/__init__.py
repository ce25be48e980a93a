"""Spark-first analytics for document-text extraction: tensors, detection, decoding, evaluation."""
