"""Readers and writers of annotated documents."""
