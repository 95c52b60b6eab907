"""Operators for building language-model training data: ten text operators and their registered queries."""
