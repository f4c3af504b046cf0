"""Column expressions; none of them needs Python on the executors."""
