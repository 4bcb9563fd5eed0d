"""Readers that give packets in the schema of ``mudline.sources.packets``."""
