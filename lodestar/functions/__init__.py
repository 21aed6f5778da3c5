"""Column functions: no Python runs for them on executors, but where their docstring says so."""
