"""Operators for preparing language-model training data. Nothing else in graintide imports this subpackage."""
