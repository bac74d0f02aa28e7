"""Part of Corvane."""
