"""Operators for preparing training text at scale: quality, deduplication, decontamination, privacy, packing, archives."""
