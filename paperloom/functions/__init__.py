"""Column functions: text, links, vectors, values, markup."""
