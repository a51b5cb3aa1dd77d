"""Part of Tidemark."""
