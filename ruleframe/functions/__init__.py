"""Column functions: reading of typed values, the scalar helpers and the fetch functions of the rules language."""
