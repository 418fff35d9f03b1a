"""Column expressions and distributed helpers shared by every operator."""
