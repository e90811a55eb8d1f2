"""Small dense mathematics in NumPy, on matrices of states: never on data that grows."""
