"""Column -> Column building blocks; everything here stays inside generated code."""
