"""Readers and writers: file trees, corpus texts, framed messages, reports."""
