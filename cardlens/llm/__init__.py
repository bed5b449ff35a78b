"""Operators for preparing training corpora (PII, language models, packing,
deduplication, search, archives, decontamination).  Nothing else in the
library imports this subpackage."""
