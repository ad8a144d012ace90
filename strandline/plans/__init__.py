"""Jobs built from the operators: assembly, flags, checks, report tables."""
