"""Column expressions: native Spark functions, plus two Arrow UDFs where none exists."""
