"""Operators for preparing language-model training text; each module holds one operator."""
