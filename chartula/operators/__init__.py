"""Relational operators: retrieval, chunking, register, answering, evaluation, table maintenance."""
