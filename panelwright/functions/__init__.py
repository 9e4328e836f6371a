"""Column expressions and the exact distributed order statistics the operators share."""
