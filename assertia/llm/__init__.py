"""Training-data operators: license scan, media columns, toxicity, decontamination, language ID,
chat formatting, source mixing, near-duplicate detection, line dedup and token counts.

Nothing outside this package imports it; removing the folder removes the feature.
"""
