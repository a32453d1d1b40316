"""Column functions: tokens, formats, fuzzy matching, date expressions."""
