"""Operators over annotated tokens, bibliographic records, annotations and topics."""
