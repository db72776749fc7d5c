"""Relational operators over long (regime, fold, class) frames."""
