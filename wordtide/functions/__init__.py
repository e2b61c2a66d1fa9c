"""Column functions: text, periods, vectors. No shuffles, no Python workers."""
