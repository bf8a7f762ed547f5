"""Column expressions. Every function takes a Column (or column name) and returns a Column."""
