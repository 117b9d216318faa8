"""Readers and writers for manifests, annotations and result tables."""
