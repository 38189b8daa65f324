"""Column functions: correlation measures, special functions, id kinds."""
