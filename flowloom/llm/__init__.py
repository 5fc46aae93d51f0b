"""Operators for preparing training data: mixing, near-duplicates, URL filters, chat formatting, token counts,
benchmark decontamination, media columns, web archives, license scans and language identification."""
